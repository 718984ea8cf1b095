"""driftaudit.sources"""
