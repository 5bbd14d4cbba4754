"""DataFrame in, DataFrame out."""

from glosswork.operators.choices import choice_expand, choice_regroup
from glosswork.operators.ids import (
    corpus_shard,
    dense_row_id,
    gather_trim,
    head_slice,
    minibatch,
    sample_n,
    seeded_shuffle,
    zip_shortest,
)
from glosswork.operators.labels import (
    apply_label_index,
    kshot,
    kshot_early_stop,
    label_index_first_seen,
    label_index_sorted,
    label_reconcile,
    num_labels,
    task_kind,
)
from glosswork.operators.manifest import parse_manifest
from glosswork.operators.metrics import (
    accuracy,
    average_ranks,
    best_so_far,
    cloze_exact_match,
    cloze_match_score,
    epoch_mean,
    gate_stats,
    glue_metric,
    macro_f1,
    metric_at_best,
    pearson,
    spearman,
)
from glosswork.operators.packing import length_batch_first, length_batches, pack_blocks, pad_batch
from glosswork.operators.pairs import project_pairs, resolve_text_columns
from glosswork.operators.prompts import prompt_fill, span_mask, span_match, with_spans
from glosswork.operators.record import change_set, manifests, read_record, refresh_record
from glosswork.operators.retrieval import (
    dense_layer,
    embed_corpus,
    fetch_docs,
    hashed_embedding,
    project_queries,
    retrieval_augment,
    retrieval_replay,
    retrieve_topk,
)
from glosswork.operators.scoring import (
    cloze_loss,
    example_reweight,
    example_weights,
    gated_mixture,
    layer_mse,
    loss_from_logits,
    mean_loss,
    predict,
    softmax,
    total_layer_mse,
    total_loss,
)
from glosswork.operators.spans import span_join
from glosswork.operators.tokens import (
    build_vocab,
    encode_ids,
    encode_pair,
    flatten_masked,
    mlm_mask,
    position_ids,
    tokenize,
    tokenize_plain,
    truncate_pad,
)
from glosswork.operators.vector_index import VectorIndex, build_index, open_index, search_index, search_with_probes

__all__ = [name for name in dir() if not name.startswith("_")]
