"""brackenlake.plans"""
