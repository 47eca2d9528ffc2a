"""spanwright.operators"""
