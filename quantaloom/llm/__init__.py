"""Operators for training-data pipelines: near copies, decontamination, mixing, classifiers and file formats."""
