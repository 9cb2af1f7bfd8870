"""textward.operators"""
