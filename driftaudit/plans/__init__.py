"""driftaudit.plans"""
