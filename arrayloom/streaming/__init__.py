"""arrayloom.streaming"""
