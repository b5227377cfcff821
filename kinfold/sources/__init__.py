"""Readers and writers of catalogs, descriptors, images and models."""
