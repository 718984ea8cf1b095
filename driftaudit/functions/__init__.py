"""driftaudit.functions"""
