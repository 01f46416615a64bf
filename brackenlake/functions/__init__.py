"""brackenlake.functions"""
