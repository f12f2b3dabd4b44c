"""seedloom.streaming"""
