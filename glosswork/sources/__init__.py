"""Readers and writers for the file shapes of the workload."""

from glosswork.sources.json_arrays import read_json_array
from glosswork.sources.ledger import number_new_files, read_ledger, read_numbered
from glosswork.sources.readers import (
    load_named_task,
    read_corpus,
    read_custom,
    read_embeddings,
    read_knowledge,
    read_metrics,
    read_task_jsonl,
)
from glosswork.sources.writers import write_embeddings, write_knowledge, write_metrics, write_task_jsonl

__all__ = [
    "load_named_task",
    "number_new_files",
    "read_corpus",
    "read_custom",
    "read_embeddings",
    "read_json_array",
    "read_knowledge",
    "read_ledger",
    "read_metrics",
    "read_numbered",
    "read_task_jsonl",
    "write_embeddings",
    "write_knowledge",
    "write_metrics",
    "write_task_jsonl",
]
