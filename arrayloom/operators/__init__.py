"""arrayloom.operators"""
