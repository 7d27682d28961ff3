"""lodestone.sinks"""
