"""driftaudit.streaming"""
