"""stereoscope: measure social bias of language models on sentence pairs, as Spark jobs.

Layers:
  sources/    table reads (corpus, specs, sentence bank) and sinks
  functions/  Column expressions (patterns, text, keys); no Python UDFs
  operators/  DataFrame -> DataFrame operators (mining, labelling, scoring, ...)
  plans/      composed flows (retrieve, generate, test a model) and the query catalog
  streaming/  the stateless mining flow applied to a file stream of documents
"""

from stereoscope.session import get_session, checkpoint_dir  # noqa: F401
