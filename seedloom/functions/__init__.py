"""seedloom.functions"""
