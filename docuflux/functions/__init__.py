"""docuflux.functions"""
