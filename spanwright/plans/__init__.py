"""spanwright.plans"""
