"""arrayloom.sources"""
