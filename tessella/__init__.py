"""Multiscale arrays, dataset catalogs and corpus preparation as Spark plans."""
