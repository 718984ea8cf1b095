"""The small labelled table that the recognizer of personal data is trained from.

Frames are written with their labels, `{T:...}` standing for an entity of type T; `<slot>` is filled from the lists below by
a seeded generator, so that the recognizer sees shapes and contexts rather than a list of values. All content is invented,
and none of the frames is taken from a table that the recognizer is measured on. Numbers of the form of an identity number
carry the label whether or not their check digits are right: what looks like one is for the model to say, whether it is one
for the check that follows.
"""

from __future__ import annotations

import random
import re

GIVEN = """
Adam Agnes Ahmet Alice Alan Amelia Amir Andrea Andrzej Anna Anton Arjun Astrid Ayşe Barbara Beatriz Bernd Birgit Bruno Carla Carlos Caroline Catherine
Cem Charles Chiara Claire Clara Daniel Daniela David Deniz Diana Diego Dilek Dmitri Dorota Edith Eduardo Elena Elif Elisa Emil Emma Emre Eric Erik Esra
Esther Eva Fatma Felix Fernando Filip Florian Frances Frank Frida Gabriel Georg Giulia Grace Greta Guillaume Gustav Hakan Hanna Hans Harriet Heinz Helena
Henrik Henry Hugo Hülya Ibrahim Ines Ingrid Irene Isabel Ivan Jack Jakub James Jan Jana Javier Jean Jelena Jens Joan Johan Jonas José Julia Julien Jürgen
Karen Karin Karl Katja Kemal Kerstin Klaus Kristina Laila Lars Laura Lea Leon Lena Leyla Liam Lina Linda Lorenzo Lucas Lucia Luis Magda Maja Malik Marc
Marco Margaret Maria Marie Marta Martin Mary Matteo Maya Mehmet Mei Michael Miguel Mika Milan Mona Murat Nadia Naomi Natalia Nazlı Nicole Niels Nina Noah Nora
Oğuz Olga Oliver Olivia Omar Otto Pablo Paola Patrick Paul Pauline Pedro Peter Petra Philip Pia Rachel Rafał René Ricardo Richard Rita Robert Roland Rosa
Ruth Ryan Sabine Samuel Sandra Sara Selim Selma Serge Sibel Simon Sofia Sonja Stefan Stéphane Susan Sven Tamara Tanja Teresa Theo Thomas Tim Tom Ulrich Ümit
Ursula Vera Victor Viktor Walter Werner William Xavier Yasemin Yann Yuki Yusuf Zeynep Zoe Zofia Łukasz Ángel Émilie Özlem Åsa Øystein Şule Çiğdem İbrahim
""".split()
FAMILY = """
Adams Aguilar Aksoy Albrecht Almeida Andersson Arslan Bailey Baker Barbier Bauer Becker Bennett Berger Bianchi Blanc Bosch Brandt Brown Bruun Caballero Campbell
Carter Çelik Chandra Clark Collins Conti Cooper Costa Çetin Dahl Davies Demir Dietrich Dubois Dupont Ekström Engel Erdoğan Evans Faure Ferrari Fischer Fletcher
Fontaine Foster Fournier Fuchs Gallo García Gauthier Gibson Gómez González Graf Grant Greco Green Gupta Gündüz Haas Hansen Harris Hartmann Hayes Hernández Hoffmann
Horváth Hughes Iversen Ivanova Jackson Jansen Janssens Jensen Johansson Jones Jørgensen Kaiser Kapoor Kaya Keller Kılıç King Klein Koç Kowalski Kraus Krüger Kurt
Lambert Lang Larsen Laurent Leclerc Lehmann Lewis Lindgren López Lorenz Ludwig Lund Maier Marchand Marino Martínez Mayer Mehta Meier Mercier Meyer Miller Moreau Moreno
Morgan Morris Müller Murphy Nelson Neumann Nguyen Nielsen Nowak O’Brien Öztürk Olsen Ortega Özdemir Palmer Parker Patel Pereira Perrin Petersen Petit Pfeiffer Polat
Porter Powell Ramos Reed Richter Rinaldi Rivera Roberts Robinson Romano Rossi Roth Rousseau Ruiz Russo Sánchez Sanders Santos Schäfer Schmidt Schneider Scholz
Schröder Schubert Schulz Schwarz Shaw Silva Simon Şahin Smith Sørensen Stewart Suárez Svensson Taylor Thompson Torres Turner Ünal Vargas Vidal Vogel Wagner Walker Ward
Watson Weber Weiß White Wilson Winkler Wolf Wood Wójcik Wright Yıldız Yılmaz Young Zimmermann Zieliński Żak Łuczak Åberg Östlund Núñez D’Angelo McCarthy
""".split()
CYRILLIC = ("Иван Анна Сергей Ольга Павел Мария Дмитрий Елена".split(), "Петров Соколова Волков Лебедева Орлов Зайцева".split())
GREEK = ("Νίκος Ελένη Γιώργος Μαρία Κώστας".split(), "Παππάς Νικολάου Γεωργίου Δήμου".split())
KANJI = ("佐藤 田中 鈴木 高橋 山本 伊藤".split(), "健太 花子 美咲 太郎 直樹".split())
STREET_EN = "Oak Elm Cedar Park Station Church High~Mill Queen Victoria Garden Bridge Lake Hill Willow Chestnut Rose Harbour Abbey King Spring Juniper Falcon Orchard".split()
STREET_KIND = "Street Street Road Road Lane Avenue Drive Court Way Close Crescent Boulevard Terrace Place St. Rd. Ave. St Rd Ave Blvd. Dr. Sq. Row Grove Square".split()
TOWN = "Hartwell Millbrook Stonebridge Eastport New~Haven Lower~Welby Cranford Redhill Silverton Greenfield Marlow Port~Ellis Saltburn Fairview Winslow".split()
TOWN_DE = "Neustadt Altenberg Rosenheim Bad~Lindau Königsfeld Waldkirch Hohenau".split()
TOWN_FR = "Montreuil Beauvallon Saint-Cyr La~Rochette Villeneuve Clairvaux".split()
TOWN_TR = "Karabük Esenler Çankaya Bodrum Üsküdar İzmit".split()
TOWN_ES = "Zamora Villalba Alcoy Toledo".split()
STREET_DE = "Hauptstraße Gartenweg Schillerstr. Am~Markt Bergstraße Rosenallee Lange~Gasse Uferplatz Goethestraße Feldweg".split()
STREET_FR = ["rue de la Paix", "avenue Foch", "rue des Lilas", "boulevard Voltaire", "place du Marché", "impasse des Cerisiers", "chemin du Moulin", "quai Saint-Michel"]
STREET_TR = "Cumhuriyet Cad.|İnönü Bulvarı|Papatya Sok.|Zafer Mah.|Barış Sokağı|Lale Caddesi|Yıldız Sok.".split("|")
STREET_ES = "Calle Mayor|Avenida de la Luz|Calle del Pozo|Plaza Nueva".split("|")
WORDS = "invoice backup parcel draft roster ledger permit contract folder ticket badge survey licence quote memo timetable voucher brochure".split()
#: Pairs of words with capitals that are no people: names of things, places, releases.
PAIRS = [f"{a} {b}" for a in "Silver Northern Green Red Open Central Lower Upper Golden Quiet Bright Great Blue White Long Early Final Royal Grand Rapid".split() for b in "Lantern Harbour Forest Meadow Station Ledger Summit Bridge Garden Council Library Protocol Archive River Team Lane Court Valley Letter Release Index Museum Edition".split()]
NOUNS_DE = "Bericht Rechnung Vertrag Lieferung Sitzung Anlage Prüfung Abteilung Übersicht Ordner Datei Bestand".split()

#: Frames with entities.
FRAMES = [
    # English
    "{NAME:<name>} signed for the <w> this morning.", "We spoke with {NAME:<name>} about the <w>.", "Ask {NAME:<name>} whether the <w> has arrived.", "The <w> was drafted by {NAME:<name>}, then checked by {NAME:<name>}.",
    "{NAME:<name>} will be away until the 14th.", "Thanks, {NAME:<name>}", "Best regards,\n{NAME:<name>}\n{PHONE:<phone>}\n{EMAIL:<mail>}", "Kind regards\n{NAME:<name>}", "cc: {NAME:<name>}; {NAME:<name>}", "Attn. {NAME:<name>}, {ADDRESS:<addr>}",
    "Tenant: {NAME:<name>} | {PHONE:<phone>}", "Caller {NAME:<name>} ({EMAIL:<mail>}) reported a broken <w>.", "Please ring {PHONE:<phone>} after lunch.", "Her mobile is {PHONE:<phone>}.", "tel {PHONE:<phone>}", "Phone: {PHONE:<phone>}, fax {PHONE:<phone>}", "T: {PHONE:<phone>} / E: {EMAIL:<mail>}",
    "dial {PHONE:<phone>} ext. <n3>", "{PHONE:<phone>} (extension <n4>)", "{PHONE:<phone>} x<n3> is the front desk", "Text {NAME:<name>} on {PHONE:<phone>}; no voicemail.", "He left the number {PHONE:<phone>} with us.",
    "Mail {EMAIL:<mail>} or {EMAIL:<mail>} if the <w> is late.", "Sent from {EMAIL:<mail>}", "Contact: {EMAIL:<mail>}", "login {EMAIL:<mail>} was locked", "unsubscribe {EMAIL:<mail>} please", "From: {NAME:<name>} <{EMAIL:<mail>}>\nTo: {EMAIL:<mail>}", "<a href=\"mailto:{EMAIL:<mail>}\">write us</a>", "mailto:{EMAIL:<mail>}?body=hello", "({EMAIL:<mail>})",
    "Deliver to {ADDRESS:<addr>}.", "{NAME:<name>}, {ADDRESS:<addr>}", "{NAME:<name>}\n{ADDRESS:<addr>}", "The office moved from {ADDRESS:<addr>} to {ADDRESS:<addr>}.", "Billing address: {ADDRESS:<addr>}", "Residence {ADDRESS:<addr>}; <w> enclosed.", "He has lived at {ADDRESS:<addr>} since 2019.", "Pick it up at {ADDRESS:<addr>} before noon.", "Return the <w> to {ADDRESS:<addr>} or call {PHONE:<phone>}.", "Mail goes to {ADDRESS:<addr>}, not to the depot.",
    "Social security {ID_NUMBER:<ssn>}", "SSN: {ID_NUMBER:<ssn>}", "SSN {ID_NUMBER:<badssn>} belongs to nobody.", "her social security number is {ID_NUMBER:<ssn>}", "Paid by card {ID_NUMBER:<card>}, thanks.", "card no {ID_NUMBER:<card>} exp 04/29", "The card {ID_NUMBER:<badcard>} was declined.", "IBAN {ID_NUMBER:<iban>}", "Wire the deposit to {ID_NUMBER:<iban>} by Tuesday.", "bank account {ID_NUMBER:<badiban>} could not be verified", "ID {ID_NUMBER:<id>}", "Identity document: {ID_NUMBER:<id>} ({NAME:<name>})", "national id {ID_NUMBER:<tckn>}", "{ID_NUMBER:<id>}", "the number {ID_NUMBER:<bad11>} failed the check", "counter {ID_NUMBER:<bad11>} rolled over", "{ID_NUMBER:<bad11>}", "ref {ID_NUMBER:<bad11>} in the <w>", "{ID_NUMBER:<card>}", "{ID_NUMBER:<iban>}", "{ID_NUMBER:<ssn>} is listed twice", "Passport holder {NAME:<name>}, ID {ID_NUMBER:<id>}, phone {PHONE:<phone>}.", "citizen no. {ID_NUMBER:<tckn>}, {NAME:<name>}",
    "Dear Mr {NAME:<name>},", "Mrs. {NAME:<name>} asked for a copy of the <w>.", "Dr. {NAME:<name>} chairs the panel with Prof. {NAME:<name>}.", "Ms {NAME:<name>} ({PHONE:<phone>}) handles the <w>.", "written by {NAME:<initials>}", "{NAME:<initials>} and {NAME:<name>} co-signed.", "guest list: {NAME:<name>}, {NAME:<name>}, {NAME:<name>}", "It was {NAME:<name>} who closed the <w>.", "According to {NAME:<name>}, nothing is missing.", "assigned to {NAME:<name>} on Monday", "Owner={NAME:<name>}; Mail={EMAIL:<mail>}", "- {NAME:<name>}: {PHONE:<phone>}", "* {NAME:<name>} <{EMAIL:<mail>}>",
    # records
    '{"name": "{NAME:<name>}", "mail": "{EMAIL:<mail>}"}', '{"tel": "{PHONE:<phone>}", "iban": "{ID_NUMBER:<iban>}"}', '{"address": "{ADDRESS:<addr>}", "owner": "{NAME:<name>}"}', "name;phone;mail\n{NAME:<name>};{PHONE:<phone>};{EMAIL:<mail>}", "{NAME:<name>}\t{PHONE:<phone>}\t{EMAIL:<mail>}", "Full name : {NAME:<name>}\nStreet : {ADDRESS:<addr>}\nTelephone : {PHONE:<phone>}\nNumber : {ID_NUMBER:<id>}", "☎ {PHONE:<phone>}", "✉ {EMAIL:<mail>} ☎ {PHONE:<phone>}", "👤 {NAME:<name>} 📍 {ADDRESS:<addr>}", "{NAME:<name>} | {ADDRESS:<addr>} | {PHONE:<phone>}", "{EMAIL:<mail>}", "{EMAIL:<mail>}, {EMAIL:<mail>}", " {EMAIL:<mail>}\n", "{PHONE:<phone>}", "{NAME:<name>}", "{ADDRESS:<addr>}", "{NAME:<name>} / {EMAIL:<mail>} / {PHONE:<phone>}", "[{NAME:<name>}]({EMAIL:<mail>})",
    # German
    "Frau {NAME:<name>} hat die Rechnung bezahlt.", "Herr {NAME:<name>} wohnt in der {ADDRESS:<addrde>}.", "Bitte rufen Sie {PHONE:<phone>} an.", "Telefon {PHONE:<phone>}, E-Mail {EMAIL:<mail>}", "Lieferung an {NAME:<name>}, {ADDRESS:<addrde>}.", "Zuständig ist {NAME:<name>} (Tel. {PHONE:<phone>}).", "Die IBAN {ID_NUMBER:<iban>} gehört {NAME:<name>}.", "Der <wde> liegt bei {NAME:<name>}.", "Wir ziehen um: {ADDRESS:<addrde>}.", "Schreiben Sie uns unter {EMAIL:<mail>}!", "Rechnungsanschrift: {ADDRESS:<addrde>}", "Durchwahl: {PHONE:<phone>}", "Mit freundlichen Grüßen\n{NAME:<name>}",
    # French
    "Mme {NAME:<name>} habite au {ADDRESS:<addrfr>}.", "Appelez {NAME:<name>} au {PHONE:<phone>}.", "Courriel : {EMAIL:<mail>}", "Téléphone : {PHONE:<phone>}", "M. {NAME:<name>} a rendu le dossier.", "Livrer chez {NAME:<name>}, {ADDRESS:<addrfr>}.", "Le virement part sur {ID_NUMBER:<iban>}.", "Merci de répondre à {EMAIL:<mail>}.", "Notre siège : {ADDRESS:<addrfr>}", "Joindre {NAME:<name>} par téléphone ({PHONE:<phone>}) ou par mail ({EMAIL:<mail>}).",
    # Turkish
    "Sayın {NAME:<name>}, kargonuz {ADDRESS:<addrtr>} adresine gidiyor.", "Telefon: {PHONE:<phone>}", "T.C. {ID_NUMBER:<tckn>}", "TC kimlik: {ID_NUMBER:<tckn>}, ad soyad: {NAME:<name>}", "{NAME:<name>} dün aradı ({PHONE:<phone>}).", "Adres: {ADDRESS:<addrtr>}", "E-posta {EMAIL:<mail>} üzerinden yazın.", "Ödeme {ID_NUMBER:<iban>} hesabına yapıldı.", "Belgeyi {NAME:<name>} imzaladı.",
    # Spanish, Portuguese, Italian, Dutch, Polish, Nordic
    "Sr. {NAME:<name>}, su factura está lista.", "Llame al {PHONE:<phone>} y pregunte por {NAME:<name>}.", "Enviar a {ADDRESS:<addres>}.", "El correo de {NAME:<name>} es {EMAIL:<mail>}.", "Cuenta {ID_NUMBER:<iban>}", "Vive en {ADDRESS:<addres>} con {NAME:<name>}.", "Fale com {NAME:<name>} pelo telefone {PHONE:<phone>}.", "Envie para {EMAIL:<mail>}, por favor.", "Chiamare {NAME:<name>} al {PHONE:<phone>}.", "Gentile {NAME:<name>}, la fattura è pronta.", "Bel {NAME:<name>} op {PHONE:<phone>}.", "Stuur het naar {EMAIL:<mail>}.", "Pani {NAME:<name>} odbierze paczkę.", "Proszę dzwonić: {PHONE:<phone>}", "Ring {NAME:<name>} på {PHONE:<phone>}.", "Hilsen {NAME:<name>}",
    # Russian, Greek, Japanese, Chinese, Korean, Arabic, Hindi, Thai
    "Звоните {NAME:<name>}: {PHONE:<phone>}.", "Документ подписал {NAME:<cyr>}, адрес {EMAIL:<mail>}.", "Счёт {ID_NUMBER:<iban>} открыт на имя {NAME:<name>}.", "Письмо для {NAME:<name>} уже отправлено.", "Телефон {PHONE:<phone>}, почтовый ящик {EMAIL:<mail>}", "Ο κύριος {NAME:<gre>} ζήτησε αντίγραφο.", "Τηλέφωνο {PHONE:<phone>}, {NAME:<name>}.", "Στείλτε το στο {EMAIL:<mail>}.", "{NAME:<kan>} 様、ご連絡ありがとうございます。", "連絡先：{NAME:<name>}（{PHONE:<phone>}）", "メールは{EMAIL:<mail>}まで。", "{NAME:<name>}さんの電話番号は{PHONE:<phone>}です。", "署名：{NAME:<name>}、{EMAIL:<mail>}", "请联系{NAME:<name>}，电话{PHONE:<phone>}。", "邮箱：{EMAIL:<mail>}", "담당자 {NAME:<name>}, 전화 {PHONE:<phone>}.", "اتصل بـ {NAME:<name>} على {PHONE:<phone>}.", "البريد {EMAIL:<mail>}", "कृपया {NAME:<name>} को {PHONE:<phone>} पर फ़ोन करें।", "ईमेल {EMAIL:<mail>}", "ติดต่อ {NAME:<name>} โทร {PHONE:<phone>}", "อีเมล {EMAIL:<mail>}",
    # more ways to say it
    "{NAME:<name>} called twice today.", "I saw {NAME:<name>} and {NAME:<name>} at the fair.", "Signed: {NAME:<name>}", "Reviewer {NAME:<name>}, editor {NAME:<name>}", "{NAME:<name>}'s <w> expired.", "for {NAME:<name>} only", "user {NAME:<name>} locked the <w>", "Patient {NAME:<name>} was moved to room <n3>.", "{NAME:<name>} (born 1984) lives at {ADDRESS:<addr>}.", "New member: {NAME:<name>}, {EMAIL:<mail>}", "Interview with {NAME:<name>} on page <n2>", "Witness {NAME:<name>} confirmed it.", "Mr. {NAME:<initials>} and Mrs. {NAME:<name>} moved away.", "The landlord, {NAME:<name>}, lives at {ADDRESS:<addr>}.", "Questions go to {NAME:<name>} ({EMAIL:<mail>}, {PHONE:<phone>}).", "handed over by {NAME:<name>} to {NAME:<name>} on {NAME:<name>}'s request", "on behalf of {NAME:<name>}", "{NAME:<name>} of the <pair> team sent the <w>.", "Please copy {NAME:<name>}; {NAME:<name>} already knows.", "(see {NAME:<name>})", "\"{NAME:<name>}\" is written on the <w>.", "The driver was {NAME:<name>}, plate unknown.", "Emergency contact {NAME:<name>}: {PHONE:<phone>}", "employee {NAME:<name>}, number {ID_NUMBER:<id>}", "Account holder: {NAME:<name>}. Account: {ID_NUMBER:<iban>}.", "Card {ID_NUMBER:<card>} was issued to {NAME:<name>}.", "refund for {NAME:<name>} to card {ID_NUMBER:<card>}", "copy of ID {ID_NUMBER:<id>} attached", "the form lists {ID_NUMBER:<id>} and {ID_NUMBER:<id>}", "SSN on the form: {ID_NUMBER:<ssn>}.", "tax file {ID_NUMBER:<ssn>} closed", "number {ID_NUMBER:<tckn>} on the <w>", "debit {ID_NUMBER:<iban>} monthly", "Use {ID_NUMBER:<card>} for tests.",
    "Reach us at {PHONE:<phone>} or {PHONE:<phone>}.", "Our new number: {PHONE:<phone>}.", "call back {PHONE:<phone>} before six", "({PHONE:<phone>})", "WhatsApp {PHONE:<phone>}", "hotline {PHONE:<phone>}, weekdays only", "The fax {PHONE:<phone>} is dead.", "phone number {PHONE:<phone>} belongs to {NAME:<name>}", "Ship it to {ADDRESS:<addr>} please", "Old: {ADDRESS:<addr>}\nNew: {ADDRESS:<addr>}", "{ADDRESS:<addr>} is the new office.", "We are at {ADDRESS:<addr>}, second floor.", "She left {ADDRESS:<addr>} in May.", "visit {ADDRESS:<addr>} on weekdays", "addr={ADDRESS:<addr>}", "The <w> was posted to {ADDRESS:<addr>} yesterday.", "write to {EMAIL:<mail>} and wait", "The sender {EMAIL:<mail>} is unknown.", "{EMAIL:<mail>} bounced", "copy {EMAIL:<mail>}; {EMAIL:<mail>}", "my address is {EMAIL:<mail>}, thanks", "account={EMAIL:<mail>} role=admin",
    "Frau {NAME:<name>} und Herr {NAME:<name>} kommen später.", "Das Paket für {NAME:<name>} liegt bereit.", "Ansprechpartnerin ist {NAME:<name>}.", "Unterschrieben von {NAME:<name>}.", "Er heißt {NAME:<name>} und wohnt {ADDRESS:<addrde>}.", "Rückfragen an {NAME:<name>} unter {PHONE:<phone>} oder {EMAIL:<mail>}.", "Neue Anschrift ab Mai: {ADDRESS:<addrde>}", "Das Büro in der {ADDRESS:<addrde>} schließt.", "Kontonummer {ID_NUMBER:<iban>}", "La cliente {NAME:<name>} a téléphoné.", "Signé par {NAME:<name>} hier.", "Nouvelle adresse : {ADDRESS:<addrfr>}.", "Le numéro de {NAME:<name>} est le {PHONE:<phone>}.", "Il habite {ADDRESS:<addrfr>} depuis mars.", "Yeni adres {ADDRESS:<addrtr>} oldu.", "Başvuru sahibi {NAME:<name>}, kimlik {ID_NUMBER:<tckn>}.", "Lütfen {PHONE:<phone>} numarasını arayın.", "{NAME:<name>} adına {ID_NUMBER:<iban>}", "La señora {NAME:<name>} firmó ayer.", "Teléfono {PHONE:<phone>}, pregunte por {NAME:<name>}", "Nueva dirección: {ADDRESS:<addres>}", "Sig.ra {NAME:<name>} ha chiamato.", "Mevrouw {NAME:<name>} woont op {ADDRESS:<addr>}.", "Paczka dla {NAME:<name>}, tel. {PHONE:<phone>}", "Заявитель {NAME:<name>}, телефон {PHONE:<phone>}.", "Подпись: {NAME:<name>}", "Почта: {EMAIL:<mail>}", "Υπεύθυνος: {NAME:<name>}, {EMAIL:<mail>}", "担当者は{NAME:<name>}です。", "お問い合わせは{PHONE:<phone>}へ。", "联系人：{NAME:<name>}", "مدير القسم {NAME:<name>}", "प्रबंधक {NAME:<name>}", "ผู้รับ {NAME:<name>}",
]

#: Frames without entities: what looks like one and is none.
PLAIN = [
    "The <pair> opens in May.", "<pair> is the working title of the new <w>.", "Our <pair> covers <n3> pages.", "Meet at <pair> at 10:30.", "The <pair> and the <pair> were merged.", "Dr. <family> is out of office.", "Mr <family> approved the <w>.", "Prof. <family> and Ms. <family> disagreed.", "Frau <family> ist krank, Herr <family> auch.", "Mme <family> a signé.", "Herr Dr. <family> prüft den <wde>.", "Sr. <family> llega mañana.", "Sayın <family> bugün yok.",
    "Version <n1>.<n2>.<n2> replaces <n1>.<n2>.<n1>.", "host 172.16.<n2>.<n3> timed out after <n2> ms", "error code <n4>-<n4> at line <n3>", "sha1 <hex> differs", "Opened on 2024-11-<d2> at <d2>:<d2>:<d2>.", "Order <n6> shipped on 03/<d2>/2025.", "ISBN 978-<n1>-<n4>-<n4>-<n1>", "See clause <n1>.<n1>, table <n2> and figures <n2>-<n2>.", "batch <n8> of <n8>", "Serial <n4>-<n4>-<n3>", "invoice no. <n5>/<n2>", "room <n3>, floor <n1>", "pages <n2>–<n3>", "ping @channel and @ops-team", "root@localhost has no mailbox", "pkg@<n1>.<n2>.<n1> depends on lib@<n1>.<n1>", "twitter handle @quietledger", "score <n2>.<n2> % of <n3>", "key=<hex>", "chapter <n1>: The <pair>", "GET /v<n1>/items/<n5> 200 <n3>ms", "due in <n2> days; <n4> items left", "1,<n3>.<n2> EUR were booked", "lat 52.<n4>, lon 13.<n4>",
    "none", "N/A", "?", "to be confirmed", "nothing personal in here", "no contact given", "Same as before.", "kein Eintrag", "aucun commentaire", "yok", "sin datos", "нет данных", "なし", "The <w> needs a second look before it goes out.", "Please update the <w> and the <w> by Friday.", "All <n2> checks passed.", "Der <wde> vom 3. Mai fehlt noch, Seite <n2>.", "Die <wde> und die <wde> sind fertig.", "Abschnitt <n1>.<n1> der Satzung", "Le rapport fait <n2> pages.", "La séance est reportée au 12 juin.", "Toplantı saat <d2>:<d2> için planlandı.", "El informe tiene <n2> páginas.", "Отчёт готов, версия <n1>.<n1>.", "Η αναφορά έχει <n2> σελίδες.", "報告書は<n2>ページです。", "会议改到下周三。", "รายงานมี <n2> หน้า", "रिपोर्ट में <n2> पृष्ठ हैं।", "التقرير من <n2> صفحة.",
    "Old Mill Road is closed for repairs.", "The bus stops in Church Lane.", "Berlin Hauptbahnhof, Gleis <n2>", "Monday Morning Report", "Terms and Conditions apply.", "United Kingdom, New Zealand and South Africa", "Microsoft Word and Adobe Reader are installed.", "January Sales Summary", "Question <n1>: Yes. Question <n1>: No.",
    "The <pair> is late again.", "A new <pair> replaces the old one.", "Welcome to <pair>!", "<pair>: summary of changes", "In the <pair> nothing moved.", "see <pair>, volume <n1>", "<pair> (second edition)", "Project <pair> ended; project <pair> began.", "“<pair>” was printed twice.", "The team visited <pair> and <pair>.", "Ticket <n5>: <pair> does not load.", "Field Notes and Quick Start are separate files.", "Data Protection Officer", "Head of Records", "Dear Customer Service,", "Dear Sir or Madam,", "Good Morning Team", "Happy New Year to all", "Access Control List and Source Version differ.", "Part One: Getting Started", "The Board of Trustees met in Lower Town.", "North Sea and Black Forest are regions.", "Saint Patrick's Day is a holiday.", "Price List Spring Edition", "Table Of Contents", "Open Source Licence", "Read Only Mode is on.", "Release Notes: Summer Update",
    "Der Bericht der Abteilung liegt im Ordner.", "Die Prüfung der Anlage dauert <n2> Tage.", "Bitte die Übersicht der Verträge an die Leitung senden.", "Im Anhang steht der Bestand vom Montag.", "Das Verzeichnis enthält Namen, Nummern und Werte.", "Neue Fassung der Regeln für den Betrieb", "Frau Dr. <family> und Herr Prof. <family> stimmen zu.", "Die Firma liefert Ende Juni.", "M. <family> et Mme <family> sont d’accord.", "Le Conseil Municipal vote mardi.", "Sr. <family> y Sra. <family> no vinieron.", "Bay <family> ve Bayan <family> geldi.", "Yeni Sürüm Notları", "Письмо господина <family> утеряно.",
    "from <d2>.<d2>.2025 to <d2>.<d2>.2026", "2025-0<n1>-<d2>T<d2>:<d2>:00Z", "<n1>.<n3>.<n3> rows in <n1>,<n2> s", "tracking <n4> <n4> <n2>", "ref. <n3>-<n3>-<n3>", "case <n2>/<n4>/<n2>", "docket <n3>.<n3>.<n3>", "lines <n3>-<n3>, columns <n2>-<n2>", "<n3> x <n3> pixels", "v<n1>.<n1>.<n1>-rc<n1>", "port <n4>, pid <n5>", "+<n2> % against last year", "-<n2>.<n1> °C", "<n2>:<n2> h", "rows <n1>–<n5>", "ratio <n1>:<n2>", "code <n3> <n3>", "part no. <n5>-<n3>", "docs/<n4>/<n3>.txt", "10.<n2>.<n3>.<n2>:<n4>", "uuid <hex>", "mirror.example.org is a host, not a mailbox", "use @here sparingly", "git@host:path has no dot", "see https://wiki.example.org/pages/<n4>", "$<n3>.<n2> and €<n4>", "§ <n2> Abs. <n1>", "No. <n3>, No. <n4>", "art. <n2>, al. <n1>", "chunk <n5> of run <n4>", "id=<n4>; next=<n4>", "snapshot <n2> holds <n6> points", "size <n6> bytes", "<n2> of <n3> failed",
]


def luhn_digit(body: str) -> str:
    total = sum(d if i % 2 else (d * 2 - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _cut(r: random.Random, s: str, size: int = 4, joins=(" ", "-", "")) -> str:
    return r.choice(joins).join(s[i : i + size] for i in range(0, len(s), size))


def _iban(r: random.Random, valid: bool = True) -> str:
    country, n = r.choice([("DE", 18), ("FR", 23), ("TR", 22), ("GB", 18), ("ES", 20), ("NL", 14), ("PL", 24)])
    bban = ("".join(r.choice("ABCNWQZX") for _ in range(4)) if country in ("GB", "NL") else "") + _digits(r, n - 4 * (country in ("GB", "NL")))
    value = int("".join(str(int(c, 36)) for c in bban + country + "00"))
    check = 98 - value % 97 if valid else r.randrange(10, 99)
    return _cut(r, f"{country}{check:02d}{bban}", joins=(" ", ""))


def _tckn(r: random.Random) -> str:
    d = [r.randrange(1, 10), *(r.randrange(10) for _ in range(8))]
    d.append((sum(d[0:9:2]) * 7 - sum(d[1:8:2])) % 10)
    return "".join(map(str, [*d, sum(d) % 10]))


def _ssn(r: random.Random) -> str:
    return r.choice("- ").join([f"{r.choice([*range(1, 666), *range(667, 900)]):03d}", f"{r.randrange(1, 100):02d}", f"{r.randrange(1, 10000):04d}"])


def _card(r: random.Random) -> str:
    body = r.choice("4456") + _digits(r, r.choice([14, 14, 14, 13, 12]))
    return _cut(r, body + luhn_digit(body))


def _case(r: random.Random, s: str) -> str:
    return r.choice([s] * 9 + [s.upper(), s.lower(), s.lower()])


_MAKE = (["ba", "ri", "lo", "ne", "ka", "su", "dor", "vel", "mi", "tan", "gre", "hol", "fen", "ost", "ma", "qui"], ["n", "nd", "rt", "ska", "lli", "ssen", "by", "ck", "vić", "ez", "man", "ova", "ğlu", "tz", "ard", "in"])


def _coined(r: random.Random) -> str:
    """A name that no list has, so that words unseen in training occur in it."""
    return "".join([r.choice(_MAKE[0]) for _ in range(r.choice([1, 2, 2, 3]))] + [r.choice(_MAKE[1])]).capitalize()


def _given(r: random.Random) -> str:
    return _coined(r) if r.random() < 0.25 else r.choice(GIVEN)


def _family(r: random.Random) -> str:
    def one() -> str:
        return _coined(r) if r.random() < 0.4 else r.choice(FAMILY)

    f = one()
    x = r.random()
    return f"{r.choice(['von', 'van der', 'de la', 'van', 'del', 'di', 'ten', 'af', 'bin', 'al'])} {f}" if x < 0.13 else f"{f}-{one()}" if x < 0.28 else f


def _name(r: random.Random) -> str:
    g, f = _given(r), _family(r)
    if r.random() < 0.06:
        g = f"{g}-{_given(r)}"
    x = r.random()
    if x < 0.14:
        return f"{f}, {g}"
    if x < 0.26:
        return f"{g[0]}. {f}"
    if x < 0.36:
        return f"{g} {_given(r)[0]}. {f}" if r.random() < 0.7 else f"{g} {_given(r)} {f}"
    return _case(r, f"{g} {f}")


_ASCII = str.maketrans("üößçğşıøåéèêñáíóúÜÖÇŞİØÅÉÁŠŚřžýÑÄäÂâ", "uoscgsioaeeenaiouUOCSIOAEASSrzyNAaAa")


def _mail(r: random.Random) -> str:
    g, f = (re.sub("[^a-z-]", "", x.translate(_ASCII).lower()) for x in (_given(r), r.choice([*FAMILY, _coined(r)])))
    local = r.choice([f"{g}.{f}", f"{g}_{f}", f"{g[0]}{f}", f"{f}{r.randrange(99)}", f"{g}-{f[0]}", f"{g}.{f}+kb"])
    host = r.choice([f"{_coined(r).translate(_ASCII).lower()}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'io', 'co.uk', 'com.tr', 'edu'])}", "example.com", "example.org", "desk.example.org", "mail.example.com", "north.example.net", "post.example.co"])
    x = r.random()
    if x < 0.08:
        return f"{local} (at) {host.replace('.', ' (dot) ')}"
    if x < 0.14:
        return f"{local} [at] {host}"
    if x < 0.18:
        return f"{local} AT {host.replace('.', ' DOT ')}"
    if x < 0.22:
        return f"{local}＠{host}"
    if x < 0.25:
        return f"{local} [at] {host.replace('.', ' [dot] ')}"
    return r.choice([f"{local}@{host}"] * 12 + [f"{local}@{host}".upper(), f"{local}@{host}".title()])


def _phone(r: random.Random) -> str:
    a, b, c, d = r.randrange(201, 990), r.randrange(200, 999), _digits(r, 4), (lambda n: _digits(r, n))
    return r.choice([
        f"+1-{a}-{b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1{a}{b}{c}", f"{a} {b} {c}", f"+1 ({a}) {b}-{c}", f"+1{a}{b}{c}", f"+49 30 {d(5)} {d(3)}", f"+49 {d(3)} {d(7)}", f"030/{d(8)}", f"0{d(3)} {d(6)}", f"0{d(3)}-{d(5)}{d(2)}", f"+49 (0){d(2)} {d(6)}",
        f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", f"0{r.randrange(1, 8)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{r.randrange(1, 8)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33{d(9)}", f"+44 20 {d(4)} {d(4)}", f"+44 7{d(3)} {d(6)}", f"0044 (0)20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}", f"07{d(3)} {d(6)}", f"+90 212 {d(3)} {d(2)} {d(2)}",
        f"0{d(3)} {d(3)} {d(2)} {d(2)}", f"(0{d(3)}) {d(3)} {d(2)} {d(2)}", f"(0{d(2)}) {d(6)}", f"+34 {d(3)} {d(3)} {d(3)}", f"+39 0{d(1)} {d(8)}", f"+7 ({d(3)}) {d(3)}-{d(2)}-{d(2)}", f"8 {d(3)} {d(3)}-{d(2)}-{d(2)}", f"+81 3-{d(4)}-{d(4)}", f"03-{d(4)}-{d(4)}", f"+48 {d(3)} {d(3)} {d(3)}", f"+30 210 {d(7)}", f"+91 {d(5)} {d(5)}", f"+66 2 {d(3)} {d(4)}",
    ])


def _address(r: random.Random, country: str = "") -> str:
    n, code = r.randrange(1, 900), _digits(r, 5)
    region = "".join(r.choice("ABCDKLMQXZNTVWY") for _ in range(2))
    uk = f"{region}{r.randrange(1, 10)} {r.randrange(1, 10)}{r.choice(['ZZ', 'AB', 'QX', 'LN'])}"
    x = {"de": 0.1, "fr": 0.2, "tr": 0.3, "es": 0.4}.get(country, r.random())

    def pick(words: list[str]) -> str:
        return r.choice(words).replace("~", " ")

    if x < 0.13:
        return f"{pick(STREET_DE)} {n}{r.choice(['', '', 'a', 'b', ' c'])}{r.choice([', ', ', ', ', D-', chr(10)])}{code} {pick(TOWN_DE)}"
    if x < 0.26:
        return f"{n}{r.choice(['', ' bis', ' ter'])}{r.choice([',', ''])} {r.choice(STREET_FR)}{r.choice([', ', ', ', chr(10)])}{code} {pick(TOWN_FR)}"
    if x < 0.39:
        return f"{pick(STREET_TR)} {r.choice([f'No: {n}', f'No:{n}', f'No. {n}', str(n)])}{r.choice([f' D: {r.randrange(1, 30)}', f' Kat: {r.randrange(1, 9)}', f' D:{r.randrange(1, 30)}', ''])}, {r.choice(['', '', f'{code} '])}{pick(TOWN_TR)}"
    if x < 0.44:
        return f"{r.choice(STREET_ES)}{r.choice([' ', ', ', ', n.º '])}{n}, {code} {pick(TOWN_ES)}"
    town = pick(TOWN) if r.random() < 0.7 else _coined(r)
    sep = r.choice([", ", ", ", ", ", chr(10)])
    if x < 0.51:
        return f"{r.choice(['P.O. Box', 'PO Box', 'P. O. Box', 'Box'])} {n}{sep}{town}, {region} {code}"
    front = r.choice(["", "", "", "", f"Flat {r.randrange(1, 40)}, ", f"Unit {r.randrange(1, 40)}, ", f"Apt {r.randrange(1, 40)}, ", f"Suite {r.randrange(1, 400)}, "])
    back = r.choice(["", "", "", "", f", Apt {r.randrange(1, 40)}{r.choice('ABC')}", f" #{r.randrange(1, 40)}"]) if not front else ""
    street = f"{front}{n}{r.choice(['', '', '', 'A', 'b'])} {pick(STREET_EN) if r.random() < 0.7 else _coined(r)} {r.choice(STREET_KIND)}{back}"
    return f"{street}{sep}{town}{r.choice([' ', ', '])}{uk}" if r.random() < 0.35 else f"{street}{sep}{town}, {region} {code}" if r.random() < 0.8 else f"{street}{sep}{town}"


def _fill(r: random.Random, slot: str) -> str:
    if slot[0] == "n" and slot[1:].isdigit():
        return str(r.randrange(10 ** (int(slot[1:]) - 1), 10 ** int(slot[1:])))
    makers = {
        "name": _name, "initials": lambda r: f"{_given(r)[0]}.{r.choice(['', ' '])}{_given(r)[0]}. {_family(r)}", "family": _family, "cyr": lambda r: f"{r.choice(CYRILLIC[0])} {r.choice(CYRILLIC[1])}", "gre": lambda r: f"{r.choice(GREEK[0])} {r.choice(GREEK[1])}", "kan": lambda r: f"{r.choice(KANJI[0])}{r.choice(['', ' '])}{r.choice(KANJI[1])}", "tckn": _tckn,
        "addrde": lambda r: _address(r, "de"), "addrfr": lambda r: _address(r, "fr"), "addrtr": lambda r: _address(r, "tr"), "addres": lambda r: _address(r, "es"), "pair": lambda r: r.choice(PAIRS), "wde": lambda r: r.choice(NOUNS_DE), "d2": lambda r: f"{r.randrange(1, 29):02d}", "mail": _mail, "phone": _phone, "addr": _address, "ssn": _ssn, "card": _card, "iban": _iban,
        "id": lambda r: r.choice([_ssn, _card, _iban, _tckn, _tckn])(r), "badssn": lambda r: r.choice("- ").join([r.choice(["000", "666", "9" + _digits(r, 2)]), _digits(r, 2), _digits(r, 4)]), "badcard": lambda r: _cut(r, "4" + _digits(r, 15)), "badiban": lambda r: _iban(r, False),
        "bad11": lambda r: _digits(r, 11), "hex": lambda r: "".join(r.choice("0123456789abcdef") for _ in range(40)), "w": lambda r: r.choice(WORDS),
    }
    return makers[slot](r)


def _blurred(r: random.Random, literal: str, share: float) -> str:
    """The literal part of a frame with a share of its words in small letters coined anew: contexts that no frame has."""
    return re.sub(r"(?<![\w<{~])[a-zà-ÿ]{2,}(?![\w>}])", lambda m: _coined(r).lower() if r.random() < share else m[0], literal) if share else literal


def labelled_rows(rows: int = 1600, seed: int = 7, frames: list[str] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """`rows` texts, each of one to three filled frames, with their entities as (start, end, type).

    `frames` are those to use, FRAMES and PLAIN unless given; leaving some out tells how the recognizer does on frames it hasn't seen.
    """
    r = random.Random(seed)
    all_frames = frames or [*FRAMES, *PLAIN]
    out = []
    for i in range(rows):
        text, spans = "", []
        chosen = [all_frames[i % len(all_frames)], *(r.choice(all_frames) for _ in range(r.choice([0, 0, 1, 1, 2])))]
        r.shuffle(chosen)
        share = r.choice([0, 0, 0, 0.4, 0.8])
        for t in chosen:
            t = "".join(_blurred(r, x, share) if i % 2 == 0 else x for i, x in enumerate(re.split(r"(\{[A-Z_]+:[^{}]*\}|<\w+>)", t)))
            t = re.sub(r"<(\w+)>", lambda m: _fill(r, m[1]) if m[1] != "EMAIL" else m[0], t)
            text += r.choice([" ", " ", "\n", "  ", "\n\n"]) if text else ""
            at = 0
            for m in re.finditer(r"\{([A-Z_]+):([^{}]*)\}", t):
                text += t[at : m.start()]
                spans.append((len(text), len(text) + len(m[2]), m[1]))
                text += m[2]
                at = m.end()
            text += t[at:]
        out.append((text, spans))
    return out
