"""docuflux.streaming"""
