"""driftaudit.operators"""
