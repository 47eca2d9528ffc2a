"""spanwright.sources"""
