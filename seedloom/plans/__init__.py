"""seedloom.plans"""
