"""seedloom.operators"""
