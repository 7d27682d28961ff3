"""lodestone.operators"""
