"""All queries over the driver's tables, by subject."""

from tessera.plans import (  # noqa: F401
    queries_evaluation,
    queries_events,
    queries_facts,
    queries_functions,
    queries_graph,
    queries_kernel,
    queries_knowledge,
    queries_lifecycle,
    queries_people,
    queries_retrieval,
    queries_review,
    queries_sequences,
    queries_video,
)
