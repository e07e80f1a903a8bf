"""Spark-native text screening and labelled-corpus construction.

``functions``  Column -> Column expressions (text, PII, language, labels, scores, chat JSON)
``operators``  DataFrame -> DataFrame building blocks (ensembles, dedupe, sampling, metrics)
``sources``    catalogues, corpora, prompt batches, the decision log and the sinks
``plans``      whole jobs put together from the above
``streaming``  the same jobs on Structured Streaming
"""
