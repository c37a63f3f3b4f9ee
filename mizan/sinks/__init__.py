"""mizan.sinks"""
