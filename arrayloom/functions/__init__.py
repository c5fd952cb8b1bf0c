"""arrayloom.functions"""
