"""Registered queries, one module per section."""

from importlib import import_module

SECTIONS = (
    "maintenance", "documents", "chunking", "retrieval", "citations", "learner", "memory",
    "canonical", "callbacks", "checks", "conversations", "feedback", "metrics", "streaming",
)


def load() -> None:
    from importlib.util import find_spec

    for name in SECTIONS:
        module = f"quillmark.plans.{name}_plans"
        if find_spec(module):
            import_module(module)
