"""docuflux.operators"""
