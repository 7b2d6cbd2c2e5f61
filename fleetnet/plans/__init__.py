"""fleetnet.plans"""
