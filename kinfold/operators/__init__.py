"""Distributed operators: splits, retrieval, evaluation, PCA, mixtures, Fisher vectors, images."""
