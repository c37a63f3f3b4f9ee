"""mizan.plans"""
