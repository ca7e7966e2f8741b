"""fieldwork: interview-analysis jobs expressed as Spark DataFrame / SQL plans.

Layout
------
- ``schemas``      fixed values (tags, labels, plan) and table schemas
- ``functions``    Column-expression builders (tag extraction, normalisation, masks, prompts)
- ``sources``      table loaders, file ingest, fixture views, report sink
- ``operators``    latest-version selection, sections, reports, scoring, insights
- ``plans``        the stage-switched job and the query registry
- ``streaming``    Structured Streaming forms of ingest and latest-answer
"""

from fieldwork.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]
