"""docuflux.sources"""
