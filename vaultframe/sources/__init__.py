"""Readers and writers of archives, indexes, browse catalogs and folders."""
