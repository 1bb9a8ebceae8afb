"""docuflux.plans"""
