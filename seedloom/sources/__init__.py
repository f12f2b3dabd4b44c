"""seedloom.sources"""
