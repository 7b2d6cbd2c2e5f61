"""fleetnet.functions"""
