"""arrayloom.plans"""
