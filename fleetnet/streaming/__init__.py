"""fleetnet.streaming"""
