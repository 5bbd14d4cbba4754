"""DuckDB SQL that gives the same answers as the registered queries."""

from __future__ import annotations

from glosswork.catalog.queries import BLOCK, BUDGET, SEED
from glosswork.catalog.views import BATCH_ROWS, CLASSES, OUT_DIMS
from glosswork.operators.pairs import TASK_COLUMNS

WORD = "[A-Za-zÀ-ÿ0-9]+"
TOKEN = "[A-Za-zÀ-ÿ0-9]+|[^A-Za-zÀ-ÿ0-9 \\t\\r\\n]"
PIECE = TOKEN + "|[ \\t\\r\\n]+"


def draw(seed: int | str, *keys: str) -> str:
    text = "||':'||".join([f"'{seed}'", *keys])
    return f"('0x'||substr(md5({text}),1,8))::bigint"


def micro(value: str) -> str:
    return f"round(({value})*1000000)::bigint"


def listed(values: str) -> str:
    return f"array_to_string({values}, ' ')"


def listed_micro(values: str) -> str:
    return listed(f"list_transform({values}, lambda q: {micro('q')})")


SOFTMAX = (
    "list_transform({0}, lambda x: exp(x - list_max({0})) / list_sum(list_transform({0}, lambda y: exp(y - list_max({0})))))"
)

# Named steps; each may use the ones before it.
STEPS = {
    "knowledge": f"""
        SELECT id,
          array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 3 THEN '{{}}' WHEN i = 7 THEN '{{}},' ELSE x END), ' ')
            || '.' AS prompt,
          list_concat(w[3:3], w[7:7]) AS targets,
          array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 7 THEN x || ',' ELSE x END), ' ') || '.' AS filled
        FROM (SELECT doc_id AS id, regexp_extract_all(text, '{WORD}') AS w FROM documents)""",
    "task": """
        SELECT d.doc_id AS id, d.text, CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS label
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "pairs": """
        SELECT a.conv_id * 100 + a.turn AS id, a.text AS sentence1, b.text AS sentence2,
          (CASE a.role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END)::bigint AS label
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "choices": """
        SELECT q.item_id AS id, q.text AS question, list(c.text ORDER BY i) AS choices,
          chr((65 + q.item_id % 5)::int) AS answerKey
        FROM benchmark q, range(5) t(i), benchmark c
        WHERE c.item_id = (q.item_id + i) % (SELECT count(*) FROM benchmark)
        GROUP BY q.item_id, q.text""",
    "tokens": f"""
        SELECT doc_id AS id, regexp_extract_all(text, '{TOKEN}') AS toks, doc_id // {BATCH_ROWS} AS bk FROM documents""",
    "vocab": f"""
        SELECT token, n AS rows, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id
        FROM (SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM tokens) GROUP BY token)""",
    "id_rows": """
        SELECT t.id, t.ix, coalesce(v.token_id, 3) AS token_id
        FROM (SELECT id, unnest(toks) AS token, generate_subscripts(toks, 1) AS ix FROM tokens) t
        LEFT JOIN vocab v ON t.token = v.token""",
    "ids": """
        SELECT d.id, d.bk, list_concat(list_concat([0], coalesce(l.ids, [])), [2]) AS input_ids
        FROM tokens d LEFT JOIN (SELECT id, list(token_id ORDER BY ix) AS ids FROM id_rows GROUP BY id) l ON d.id = l.id""",
    "padded": f"""
        SELECT id, list_concat(input_ids[1:{BLOCK}], list_transform(range(greatest({BLOCK} - len(input_ids), 0)), lambda z: 1))
            AS input_ids,
          list_concat(list_transform(range(least({BLOCK}, len(input_ids))), lambda z: 1),
            list_transform(range(greatest({BLOCK} - len(input_ids), 0)), lambda z: 0)) AS attention_mask
        FROM ids""",
    "whole": """
        SELECT id, list_concat(input_ids, list_transform(range(id % 4), lambda z: 1)) AS input_ids,
          list_concat(list_transform(input_ids, lambda z: 1), list_transform(range(id % 4), lambda z: 0)) AS attention_mask
        FROM ids""",
    "flat_ids": """
        SELECT bk, id, ix, token_id,
          row_number() OVER (PARTITION BY bk ORDER BY id, ix) - 1 AS place
        FROM (SELECT bk, id, unnest(input_ids) AS token_id, generate_subscripts(input_ids, 1) AS ix FROM ids)""",
    "packed": f"""
        SELECT bk AS batch, place // {BLOCK} AS block, list(token_id ORDER BY place) AS input_ids
        FROM flat_ids GROUP BY bk, place // {BLOCK} HAVING count(*) = {BLOCK} OR place // {BLOCK} = 0""",
    "sized": "SELECT id, bk, len(toks) AS n_items FROM tokens WHERE len(toks) > 0",
    "vectors": "SELECT vec_id AS id, embedding::DOUBLE[] AS embedding FROM embeddings",
    "corpus": "SELECT doc_id AS raw_id, text FROM documents",
    "doc_vectors": """
        SELECT d.doc_id AS id, list_transform(e.embedding::DOUBLE[], lambda x: x * (1 + (d.doc_id // n) / 8.0::DOUBLE)) AS embedding
        FROM documents d, (SELECT count(*) AS n FROM embeddings), embeddings e WHERE e.vec_id = d.doc_id % n""",
    "doc_hits": """
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, raw_id) AS rank, raw_id, score
        FROM (SELECT q.id AS query_id, r.id AS raw_id, round(list_inner_product(q.embedding, r.embedding), 9) AS score
          FROM doc_vectors q, doc_vectors r)""",
    "asked_hits": """
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, raw_id) AS rank, raw_id, score
        FROM (SELECT q.id AS query_id, r.id AS raw_id, round(list_inner_product(q.embedding, r.embedding), 9) AS score
          FROM vectors q, doc_vectors r)""",
    "hits": """
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, raw_id) AS rank, raw_id, score
        FROM (SELECT q.id AS query_id, r.id AS raw_id, round(list_inner_product(q.embedding, r.embedding), 9) AS score
          FROM vectors q, vectors r)""",
    "logits": f"""
        SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'valid' END AS split, vec_id % 3 AS epoch,
          embedding[1:{CLASSES}]::DOUBLE[] AS logits, label,
          list_position(embedding[1:{CLASSES}], list_max(embedding[1:{CLASSES}]))::bigint - 1 AS pred
        FROM embeddings""",
    "cloze": """
        SELECT l_orderkey AS id, l_orderkey // 10 AS batch, l_linenumber % 2 = 1 AS masked, l_suppkey % 20 AS correct_id,
          l_suppkey % 20 + CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END AS pred_id, -(l_tax + 0.01::DOUBLE) AS logp
        FROM lineitem""",
    "points": """
        SELECT user_id AS run, day(ts) AS epoch, event_id AS step, event_type AS metric, value FROM events""",
    "epochs": """
        SELECT run, epoch, metric, avg(value) AS value, count(value) AS batches FROM points GROUP BY ALL""",
    "drawn": f"""
        SELECT doc_id AS id, text, lang, source, row_number() OVER (ORDER BY {draw(SEED, 'doc_id')}, doc_id) - 1 AS place
        FROM documents""",
    "weight": f"""
        SELECT i, j, ({draw(11, 'i', 'j')} % 2001 - 1000) / 4000.0::DOUBLE AS w FROM range(64) a(i), range({OUT_DIMS}) b(j)""",
    "dense": f"""
        SELECT x.id, w.j, sum(x.e * w.w) + any_value(({draw(12, 'w.j')} % 2001 - 1000) / 4000.0::DOUBLE) AS y
        FROM (SELECT id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM vectors) x
        JOIN weight w ON x.i = w.i GROUP BY x.id, w.j""",
    "gate_logits": f"""
        SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'valid' END AS split, vec_id % 3 AS epoch,
          {SOFTMAX.format('embedding[49:51]::DOUBLE[]')} AS p7, {SOFTMAX.format('embedding[52:54]::DOUBLE[]')} AS p11,
          embedding::DOUBLE[] AS e
        FROM embeddings""",
    "scored": """
        SELECT id, bool_and(NOT masked OR pred_id = correct_id) AS good,
          avg(logp) FILTER (masked AND correct_id <> 0) AS logp
        FROM cloze GROUP BY id""",
    "batch_loss": """
        SELECT batch, avg(loss) AS loss, count(loss) AS examples
        FROM (SELECT batch, id, avg(-logp) FILTER (masked) AS loss FROM cloze GROUP BY ALL) GROUP BY batch""",
    "reweighted": """
        SELECT l_orderkey // 10 AS batch, sum(exp(l_discount) * l_tax) / sum(exp(l_discount)) AS loss, count(*) AS examples
        FROM lineitem GROUP BY ALL""",
    "spans": """
        SELECT k.id, s.j - 1 AS span_no, strpos(k.filled, k.targets[s.j]) - 1 AS b,
          strpos(k.filled, k.targets[s.j]) - 1 + length(k.targets[s.j]) AS e
        FROM knowledge k, range(1, 3) s(j) WHERE s.j <= len(k.targets) AND strpos(k.filled, k.targets[s.j]) > 0""",
    "filled_tokens": f"""
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY ix) - 1 AS token_no, e - length(piece) AS b, e, piece AS tok
        FROM (SELECT id, ix, piece, sum(length(piece)) OVER (PARTITION BY id ORDER BY ix) AS e
          FROM (SELECT id, unnest(p) AS piece, generate_subscripts(p, 1) AS ix
            FROM (SELECT id, regexp_extract_all(filled, '{PIECE}') AS p FROM knowledge)))
        WHERE NOT regexp_matches(piece, '^[ \\t\\r\\n]')""",
}
STEP_NEEDS = {
    "vocab": ["tokens"],
    "id_rows": ["vocab"],
    "ids": ["id_rows"],
    "padded": ["ids"],
    "whole": ["ids"],
    "flat_ids": ["ids"],
    "packed": ["flat_ids"],
    "sized": ["tokens"],
    "hits": ["vectors"],
    "doc_hits": ["doc_vectors"],
    "asked_hits": ["vectors", "doc_vectors"],
    "epochs": ["points"],
    "dense": ["vectors", "weight"],
    "scored": ["cloze"],
    "batch_loss": ["cloze"],
    "spans": ["knowledge"],
    "filled_tokens": ["knowledge"],
}


def steps(names: list[str], body: str, recursive: bool = False) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for need in STEP_NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = ",\n".join(f"{n} AS ({STEPS[n]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{body}"


PAIR_TASKS = ", ".join(f"'{n}'" for n in TASK_COLUMNS)
MARKS = (
    "list_transform(logits, lambda x, i: greatest(x, 0) - x * (CASE WHEN i - 1 = label THEN 1 ELSE 0 END) + ln(1 + exp(-abs(x))))"
)
LOG_SUM = "list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))"
BATCH_CHAIN = f"""
, ranked AS (SELECT grp, item, n_items, row_number() OVER (PARTITION BY grp ORDER BY n_items DESC, item) - 1 AS place FROM items),
chain(grp, place, width, batch_no) AS (
  SELECT grp, place, n_items, 0::bigint FROM ranked WHERE place = 0
  UNION ALL
  SELECT r.grp, r.place, r.n_items, c.batch_no + 1 FROM chain c JOIN ranked r
    ON r.grp = c.grp AND r.place = c.place + greatest(1, {BUDGET} // c.width))
, placed AS (SELECT r.grp, r.item, r.n_items, c.batch_no FROM ranked r JOIN chain c
  ON c.grp = r.grp AND r.place >= c.place AND r.place < c.place + greatest(1, {BUDGET} // c.width))
"""
RANKED_PAIR = """
  SELECT {g}, rank() OVER (PARTITION BY {g} ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY {g}, l_extendedprice) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY {g} ORDER BY l_quantity) + (count(*) OVER (PARTITION BY {g}, l_quantity) - 1) / 2.0::DOUBLE AS ry
  FROM lineitem"""
CLASS_F1 = """
, cells AS (SELECT split, pred AS class, (pred = label)::int AS tp, (pred <> label)::int AS fp, 0 AS fn FROM logits
  UNION ALL SELECT split, label, 0, 0, (pred <> label)::int FROM logits)
, classes AS (SELECT split, class, 2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f1 FROM cells GROUP BY ALL)
"""

ORACLE: dict[str, str] = {
    "read_knowledge": steps(["knowledge"], "SELECT id, prompt, array_to_string(targets, '|') AS targets FROM knowledge"),
    "read_task_jsonl": steps(["task"], "SELECT text, label FROM task"),
    "read_custom": """
        SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'validation' ELSE 'train' END AS split, o_orderkey, o_custkey,
          o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""",
    "read_corpus": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS raw_id, text FROM documents",
    "embedding_store": f"SELECT vec_id AS raw_id, {listed_micro('embedding::DOUBLE[]')} AS embedding FROM embeddings",
    "load_named_task": steps(
        ["pairs"], "SELECT *, CASE WHEN id % 4 = 0 THEN 'validation' ELSE 'train' END AS split FROM pairs"
    ),
    "metric_log": steps(["points"], "SELECT * FROM points"),
    "resolve_text_columns": steps(
        ["pairs"],
        """SELECT 'named' AS shape, id, sentence1 AS text1, sentence2 AS text2 FROM pairs
        UNION ALL SELECT 'pair', id, sentence1, sentence2 FROM pairs
        UNION ALL SELECT 'first two', doc_id, text, source FROM documents
        UNION ALL SELECT 'single', doc_id, text, NULL FROM documents""",
    ),
    "project_pairs": steps(
        ["pairs"], "SELECT id, sentence1 AS text1, sentence2 AS text2, label + 10 AS labels FROM pairs"
    ),
    "prompt_fill": steps(["knowledge"], "SELECT id, trim(filled) AS text FROM knowledge"),
    "prompt_fill_or_raw": f"""
        SELECT id, CASE WHEN id % 5 = 0 OR len(w) < 7 THEN array_to_string(w, ' ')
            ELSE array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 7 THEN x || ',' ELSE x END), ' ') END || '.' AS text
        FROM (SELECT doc_id AS id, regexp_extract_all(text, '{WORD}') AS w FROM documents)""",
    "snippet": "SELECT doc_id AS id, array_to_string(string_split(text, '.')[1:3], ' ') AS snippet FROM documents",
    "tokenize_offsets": f"""
        WITH pieces AS (SELECT id, unnest(p) AS piece, generate_subscripts(p, 1) AS ix
          FROM (SELECT doc_id AS id, regexp_extract_all(text, '{PIECE}') AS p FROM documents)),
        placed AS (SELECT id, ix, piece, sum(length(piece)) OVER (PARTITION BY id ORDER BY ix) AS e FROM pieces),
        lists AS (SELECT id, count(*) AS n, string_agg(piece, ' ' ORDER BY ix) AS toks,
            string_agg((e - length(piece))::bigint, ' ' ORDER BY ix) AS begins, string_agg(e::bigint, ' ' ORDER BY ix) AS ends
          FROM placed WHERE NOT regexp_matches(piece, '^[ \\t\\r\\n]') GROUP BY id)
        SELECT d.doc_id AS id, coalesce(n, 0) AS n_tokens, coalesce(toks, '') AS toks, coalesce(begins, '') AS begins,
          coalesce(ends, '') AS ends FROM documents d LEFT JOIN lists l ON d.doc_id = l.id""",
    "build_vocab": steps(["vocab"], "SELECT token, rows, token_id FROM vocab"),
    "encode_ids": steps(["ids"], f"SELECT id, {listed('input_ids')} AS input_ids FROM ids"),
    "truncate_pad": steps(
        ["padded"],
        f"SELECT id, {listed('input_ids')} AS input_ids, {listed('attention_mask')} AS attention_mask FROM padded",
    ),
    "position_ids": steps(
        ["whole"],
        f"""SELECT id, string_agg(ix - 1, ' ' ORDER BY ix) AS plain, string_agg(CASE WHEN t = 1 THEN 1 ELSE n + 1 END, ' ' ORDER BY ix) AS after_padding
        FROM (SELECT id, t, ix, sum((t <> 1)::int) OVER (PARTITION BY id ORDER BY ix)::bigint AS n
          FROM (SELECT id, unnest(input_ids) AS t, generate_subscripts(input_ids, 1) AS ix FROM whole)) GROUP BY id""",
    ),
    "choice_expand": steps(
        ["choices"],
        """SELECT id, question, answerKey, unnest(choices) AS choice_text, generate_subscripts(choices, 1) - 1 AS choice
        FROM choices""",
    ),
    "choice_regroup": f"""
        WITH s AS (SELECT item_id AS id, c AS choice, {draw(7, 'item_id', 'c')} % 1000 AS score FROM benchmark, range(5) t(c))
        SELECT id, string_agg(score, ' ' ORDER BY choice) AS scores, first(choice ORDER BY score DESC, choice) AS winner
        FROM s GROUP BY id""",
    "letter_index": "SELECT item_id AS id, item_id % 5 AS label FROM benchmark",
    "flatten_masked": steps(
        ["whole"],
        """SELECT id, ix - 1 AS pos, t AS token_id
        FROM (SELECT id, unnest(input_ids) AS t, unnest(attention_mask) AS m, generate_subscripts(input_ids, 1) AS ix FROM whole)
        WHERE m = 1""",
    ),
    "experiment_manifest": f"""
        WITH named AS (SELECT ['csqa','mrpc','sst2','amazon','cola','hyper'][p_partkey % 6 + 1] AS dataset,
            ['finetune','houlsby','pfeiffer-domain','lora-domain'][p_partkey % 4 + 1] AS type, p_size, p_partkey FROM part)
        SELECT dataset || '_' || type || '_' || p_size || '_1e-4_seed' || p_partkey AS run_name, dataset, type,
          p_size::bigint AS batch_size, 0.0001::DOUBLE AS lr, p_partkey AS seed, (type LIKE '%-domain')::bigint AS domain_adapter,
          CASE WHEN type = 'finetune' THEN NULL ELSE split_part(type, '-', 1) END AS adapter_type,
          CASE WHEN dataset = 'csqa' THEN 'csqa' WHEN dataset IN ({PAIR_TASKS}) THEN 'glue' ELSE 'others' END AS runner,
          CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 3 END AS few_shot FROM named""",
    "encode_pair": steps(
        ["pairs", "vocab"],
        f"""
        , sides AS (SELECT id, 1 AS side, regexp_extract_all(sentence1, '{TOKEN}') AS toks FROM pairs
          UNION ALL SELECT id, 2, regexp_extract_all(sentence2, '{TOKEN}') FROM pairs)
        , coded AS (SELECT s.id, s.side, s.ix, coalesce(v.token_id, 3) AS t FROM
          (SELECT id, side, unnest(toks) AS token, generate_subscripts(toks, 1) AS ix FROM sides) s LEFT JOIN vocab v ON s.token = v.token)
        , lists AS (SELECT p.id, coalesce(list(t ORDER BY ix) FILTER (side = 1), []) AS x, coalesce(list(t ORDER BY ix) FILTER (side = 2), []) AS y
          FROM pairs p LEFT JOIN coded c ON p.id = c.id GROUP BY p.id)
        , room AS (SELECT *, CASE WHEN len(x) + len(y) <= 60 THEN len(x) WHEN least(len(x), len(y)) >= 30 THEN 30
              WHEN len(x) <= len(y) THEN len(x) ELSE 60 - len(y) END AS nx,
            CASE WHEN len(x) + len(y) <= 60 THEN len(y) WHEN least(len(x), len(y)) >= 30 THEN 30
              WHEN len(x) <= len(y) THEN 60 - len(x) ELSE len(y) END AS ny FROM lists)
        SELECT id, {listed('list_concat([0], x[1:nx], [2, 2], y[1:ny], [2])')} AS input_ids FROM room""",
    ),
    "dense_row_id": """
        SELECT doc_id AS id, lang, source, row_number() OVER (ORDER BY lang, source, doc_id) - 1 AS row_id FROM documents""",
    "head_slice": """
        WITH n AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents)
        SELECT 100::bigint AS size, id, row_id FROM n WHERE row_id < 100
        UNION ALL SELECT -1, id, row_id FROM n WHERE row_id < (SELECT count(*) FROM documents) - 1""",
    "seeded_shuffle": steps(["drawn"], "SELECT id, place AS shuffled FROM drawn"),
    "corpus_shard": """
        WITH n AS (SELECT doc_id AS id, text, row_number() OVER (ORDER BY doc_id) - 1 AS p,
            (SELECT count(*) FROM documents) // 3 AS width FROM documents)
        SELECT id, text, p - least(p // width, 2) * width AS row_id, least(p // width, 2) AS shard FROM n""",
    "kshot": steps(
        ["drawn"],
        """SELECT id, text, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY place) AS shot FROM drawn
        QUALIFY shot <= 16""",
    ),
    "kshot_early_stop": steps(
        ["drawn"],
        """
        , named AS (SELECT id, text, lang || '_' || source AS label, place FROM drawn)
        , firsts AS (SELECT min(place) AS f FROM named GROUP BY label)
        , gaps AS (SELECT f, lead(f) OVER (ORDER BY f) AS g FROM firsts)
        , stop AS (SELECT min(f) + 100 AS ix FROM gaps WHERE g IS NULL OR g - f > 100)
        SELECT id, text, label, row_number() OVER (PARTITION BY label ORDER BY place) AS shot
        FROM named, stop WHERE place < ix QUALIFY shot <= 2""",
    ),
    "label_index_first_seen": """
        WITH named AS (SELECT doc_id AS id, lang || '_' || source AS label FROM documents),
        firsts AS (SELECT label, min((CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) * 1000000000000 + id) AS f FROM named GROUP BY label),
        numbered AS (SELECT label, row_number() OVER (ORDER BY f) - 1 AS label_id FROM firsts)
        SELECT n.id, n.label, i.label_id FROM named n JOIN numbered i ON n.label = i.label""",
    "label_index_sorted": """
        SELECT doc_id AS id, lang || '_' || source AS label,
          dense_rank() OVER (ORDER BY lang || '_' || source) - 1 AS label_id FROM documents""",
    "label_reconcile": """
        WITH data AS (SELECT lang AS name, row_number() OVER (ORDER BY lang) - 1 AS idx FROM documents GROUP BY lang)
        SELECT name, 100 - idx AS label_id, 1::bigint AS from_model, 'same' AS side FROM data
        UNION ALL SELECT name, idx, 0, 'other' FROM data""",
    "sample_n": steps(["drawn"], "SELECT id, text FROM drawn WHERE place < 3"),
    "minibatch": """
        SELECT doc_id // 16 AS batch_id, count(*) AS rows, string_agg(text, chr(10) ORDER BY doc_id) AS texts,
          string_agg(lang, ' ' ORDER BY doc_id) AS langs FROM documents GROUP BY ALL HAVING count(*) = 16""",
    "gather_trim": steps(["logits"], "SELECT id, label::bigint AS label, pred FROM logits"),
    "zip_shortest": """
        WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id AS id, text FROM documents),
        b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, item_id, text AS other FROM benchmark)
        SELECT a.pos, a.id, a.text, b.item_id, b.other FROM a JOIN b ON a.pos = b.pos""",
    "retrieve_topk": steps(
        ["hits"], "SELECT query_id, rank, raw_id, round(score, 6) AS score FROM hits WHERE rank <= 5"
    ),
    "project_queries": steps(
        ["dense"], f"SELECT id, string_agg({micro('y')}, ' ' ORDER BY j) AS embedding FROM dense GROUP BY id"
    ),
    "fetch_docs": steps(
        ["asked_hits", "corpus"],
        """SELECT h.query_id, h.rank, h.raw_id, c.text FROM asked_hits h LEFT JOIN corpus c ON h.raw_id = c.raw_id
        WHERE h.rank <= 3""",
    ),
    "retrieval_augment": steps(
        ["doc_hits", "corpus"],
        """SELECT q.raw_id AS id,
          string_agg(array_to_string(string_split(c.text, '.')[1:3], ' '), '</s>' ORDER BY h.rank) || '</s>' || any_value(q.text) AS augmented
        FROM corpus q JOIN doc_hits h ON q.raw_id = h.query_id AND h.rank <= 2 JOIN corpus c ON h.raw_id = c.raw_id
        GROUP BY q.raw_id""",
    ),
    "retrieval_replay": steps(
        ["doc_hits", "corpus"],
        f"""
        , items AS (SELECT h.query_id // {BATCH_ROWS} AS grp, h.query_id * 2 + h.rank - 1 AS item, h.raw_id,
            len(regexp_extract_all(c.text, '{TOKEN}')) AS n_items FROM doc_hits h JOIN corpus c ON h.raw_id = c.raw_id
          WHERE h.rank <= 2 AND len(regexp_extract_all(c.text, '{TOKEN}')) > 0)
        {BATCH_CHAIN}
        SELECT p.grp AS bk, p.item, i.raw_id, p.n_items, p.batch_no FROM placed p JOIN items i ON p.item = i.item""",
        recursive=True,
    ),
    "span_match": steps(
        ["spans", "filled_tokens"],
        """SELECT t.id, t.token_no, s.span_no, t.tok FROM filled_tokens t JOIN spans s
        ON t.id = s.id AND t.e >= s.b AND t.b <= s.e""",
    ),
    "embed_corpus": steps(
        ["tokens"],
        f"""
        , hashed AS (SELECT id, {draw(0, 'token')} % 64 AS bucket FROM (SELECT id, unnest(toks) AS token FROM tokens))
        , counted AS (SELECT d.id, b.bucket, count(h.id) AS n FROM (SELECT id FROM tokens) d CROSS JOIN range(64) b(bucket)
            LEFT JOIN hashed h ON h.id = d.id AND h.bucket = b.bucket GROUP BY ALL)
        , scaled AS (SELECT id, bucket, n / nullif(sqrt(sum(n * n) OVER (PARTITION BY id)), 0) AS x FROM counted)
        SELECT id AS raw_id, string_agg({micro('coalesce(x, 0)')}, ' ' ORDER BY bucket) AS embedding FROM scaled GROUP BY id""",
    ),
    "span_mask": steps(
        ["spans", "filled_tokens"],
        """
        , flagged AS (SELECT t.id, t.token_no, t.tok, EXISTS (SELECT 1 FROM spans s WHERE s.id = t.id AND t.e >= s.b AND t.b <= s.e) AS m
          FROM filled_tokens t)
        SELECT id, string_agg(CASE WHEN m THEN '<mask>' ELSE tok END, ' ' ORDER BY token_no) AS masked,
          string_agg(tok, ' ' ORDER BY token_no) AS labels, count(*) FILTER (m) AS n_masked FROM flagged GROUP BY id""",
    ),
    "pack_blocks": steps(
        ["packed"], f"SELECT batch, block, len(input_ids) AS n_items, {listed('input_ids')} AS input_ids FROM packed"
    ),
    "mlm_mask": steps(
        ["packed"],
        f"""
        , flat AS (SELECT batch, block, unnest(input_ids) AS t, generate_subscripts(input_ids, 1) - 1 AS ix FROM packed)
        , digests AS (SELECT *, substr(md5('{SEED}:' || batch || ':' || block || ':' || (ix // 4)), ix % 4 * 8 + 1, 8) AS d,
            md5('{SEED}:' || batch || ':' || block || ':' || ix || ':m') AS m FROM flat)
        , draws AS (SELECT batch, block, ix, t, ('0x'||d)::bigint AS a, ('0x'||substr(m,1,8))::bigint AS b,
            ('0x'||substr(m,9,8))::bigint AS c FROM digests)
        , fates AS (SELECT *, t NOT IN (0, 1, 2) AND a < {int(0.15 * 2**32)} AS chosen FROM draws)
        SELECT batch, block, string_agg(CASE WHEN NOT chosen THEN t WHEN b < {int(0.8 * 2**32)} THEN v
            WHEN b < {int(0.9 * 2**32)} THEN c % v ELSE t END, ' ' ORDER BY ix) AS masked_ids,
          string_agg(CASE WHEN chosen THEN t ELSE -100 END, ' ' ORDER BY ix) AS labels FROM fates, (SELECT count(*) + 4 AS v FROM vocab) GROUP BY batch, block""",
    ),
    "length_batches": steps(
        ["sized"],
        f"""
        , items AS (SELECT bk AS grp, id AS item, n_items FROM sized)
        {BATCH_CHAIN}
        SELECT item AS id, grp AS bk, n_items, batch_no FROM placed""",
        recursive=True,
    ),
    "length_batch_first": steps(
        ["sized"],
        f"""SELECT id, bk, n_items FROM sized
        QUALIFY row_number() OVER (PARTITION BY bk ORDER BY n_items DESC, id)
          <= greatest(1, {BUDGET} // max(n_items) OVER (PARTITION BY bk))""",
    ),
    "pad_batch": steps(
        ["ids"],
        f"""
        , cut AS (SELECT id, id // 4 AS grp, input_ids AS a FROM ids)
        , wide AS (SELECT *, max(len(a)) OVER (PARTITION BY grp) AS width FROM cut)
        SELECT id, width, {listed('list_concat(a, list_transform(range(width - len(a)), lambda z: 0))')} AS input_ids,
          {listed('list_concat(list_transform(a, lambda z: 1), list_transform(range(width - len(a)), lambda z: 0))')} AS attention_mask
        FROM wide""",
    ),
    "predict": steps(["logits"], "SELECT id, pred, round(logits[1], 6) AS value FROM logits"),
    "softmax": steps(
        ["logits"],
        f"""SELECT id, {listed_micro(SOFTMAX.format('logits'))} AS probs,
        {listed_micro(f'list_transform(logits, lambda v: v - ({LOG_SUM}))')} AS logs FROM logits""",
    ),
    "accuracy": steps(
        ["logits"],
        """SELECT split, epoch, round(avg((pred = label)::int), 6) AS accuracy, count(*) AS rows FROM logits GROUP BY ALL""",
    ),
    "macro_f1": steps(
        ["logits"],
        f"""{CLASS_F1}
        SELECT split, round(avg(f1), 6) AS macro_f1, round(sum(f1) / {CLASSES}, 6) AS with_absent FROM classes GROUP BY split""",
    ),
    "glue_metric": f"""
        WITH rows AS (SELECT (l_tax > 0.04::DOUBLE)::int AS y, (l_tax + l_discount > 0.09::DOUBLE)::int AS p FROM lineitem),
        c AS (SELECT count(*) FILTER (p = 1 AND y = 1)::DOUBLE AS tp, count(*) FILTER (p = 1 AND y = 0)::DOUBLE AS fp,
          count(*) FILTER (p = 0 AND y = 1)::DOUBLE AS fn, count(*) FILTER (p = 0 AND y = 0)::DOUBLE AS tn,
          avg((p = y)::int) AS acc FROM rows),
        ranked AS ({RANKED_PAIR.format(g='1::int').replace('SELECT 1::int,', 'SELECT')})
        SELECT 'cola' AS task, 'matthews_correlation' AS metric,
          round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS value FROM c
        UNION ALL SELECT 'mrpc', 'accuracy', round(acc, 6) FROM c
        UNION ALL SELECT 'mrpc', 'f1', round(2 * tp / (2 * tp + fp + fn), 6) FROM c
        UNION ALL SELECT 'sst2', 'accuracy', round(acc, 6) FROM c
        UNION ALL SELECT 'stsb', 'pearson', round(corr(l_quantity, l_extendedprice), 6) FROM lineitem
        UNION ALL SELECT 'stsb', 'spearmanr', round(corr(rx, ry), 6) FROM ranked""",
    "pearson": """
        SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS pearson FROM lineitem GROUP BY l_returnflag""",
    "spearman": f"""
        WITH ranked AS ({RANKED_PAIR.format(g='l_returnflag')})
        SELECT l_returnflag, round(corr(rx, ry), 6) AS spearman FROM ranked GROUP BY l_returnflag""",
    "cloze_exact_match": steps(["scored"], "SELECT round_even(avg(good::int) * 100, 2) AS exact_match FROM scored"),
    "cloze_match_score": steps(
        ["scored"], "SELECT round_even(avg(round_even(exp(logp) * 100, 2)), 2) AS match_score FROM scored"
    ),
    "cloze_loss": steps(["batch_loss"], "SELECT batch, round(loss, 9) AS loss, examples FROM batch_loss"),
    "loss_from_logits": steps(
        ["logits"],
        f"""SELECT id, CASE WHEN id % 10 <> 0 THEN round({LOG_SUM} - logits[label + 1], 6) END AS cross_entropy,
          round(list_avg({MARKS}), 6) AS binary, round((logits[1] - label) * (logits[1] - label), 6) AS squared FROM logits""",
    ),
    "layer_mse": """
        SELECT vec_id % 2 AS layer, round(avg(list_sum(list_transform(range(1, 33),
          lambda i: (embedding[i]::DOUBLE - embedding[i + 32]::DOUBLE) ** 2)) / 32), 6) AS mse, count(*) AS rows
        FROM embeddings GROUP BY ALL""",
    "example_reweight": steps(["reweighted"], "SELECT batch, round(loss, 9) AS loss, examples FROM reweighted"),
    "dense_layer": steps(
        ["dense"],
        f"""SELECT id, string_agg({micro('tanh(y)')}, ' ' ORDER BY j) AS tanh,
        string_agg({micro('greatest(y, 0)')}, ' ' ORDER BY j) AS relu FROM dense GROUP BY id""",
    ),
    "dense_gelu": steps(
        ["dense"],
        f"""
        , z AS (SELECT id, j, y, y / sqrt(2.0) AS x FROM dense)
        , e AS (SELECT id, j, y, 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 60),
            lambda n: x * pow(4 * x * x, n) * gamma(n + 1) / gamma(2 * n + 2))) AS erf FROM z)
        SELECT id, string_agg({micro('0.5 * y * (1 + erf)')}, ' ' ORDER BY j) AS gelu FROM e GROUP BY id""",
    ),
    "gated_mixture": steps(
        ["gate_logits"],
        f"""SELECT id, {listed_micro('list_transform(range(1, 17), lambda i: p7[1] * e[i] + p7[2] * e[i + 16] + p7[3] * e[i + 32])')} AS mixed
        FROM gate_logits""",
    ),
    "gate_stats": steps(
        ["gate_logits"],
        """SELECT split, epoch, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std, count(*) AS rows
        FROM (SELECT split, epoch, p7[1] AS w FROM gate_logits UNION ALL SELECT split, epoch, p11[1] FROM gate_logits)
        GROUP BY ALL""",
    ),
    "epoch_mean": steps(["epochs"], "SELECT run, epoch, metric, round(value, 6) AS value, batches FROM epochs"),
    "best_so_far": steps(
        ["epochs"],
        """SELECT run, metric, epoch, round(greatest(max(value) OVER (PARTITION BY run, metric ORDER BY epoch), 0), 6) AS best
        FROM epochs""",
    ),
    "metric_at_best": steps(
        ["epochs"],
        """SELECT a.run, a.epoch, round(a.value, 6) AS valid, round(b.value, 6) AS test
        FROM (SELECT * FROM epochs WHERE metric = 'view' QUALIFY row_number() OVER (PARTITION BY run ORDER BY value DESC, epoch) = 1) a
        LEFT JOIN epochs b ON a.run = b.run AND a.epoch = b.epoch AND b.metric = 'purchase'""",
    ),
    "total_loss": steps(
        ["batch_loss", "reweighted"],
        """SELECT k.batch, round(0.5::DOUBLE * k.loss + s.loss, 9) AS total_loss
        FROM batch_loss k JOIN reweighted s ON k.batch = s.batch""",
    ),
    "stream_metric_rollup": """
        SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS metric,
          round(avg(value), 6) AS value, count(value) AS points FROM events GROUP BY ALL""",
    "stream_prepare": f"""
        SELECT doc_id AS id, array_to_string(string_split(text, '.')[1:3], ' ') AS snippet,
          dense_rank() OVER (ORDER BY lang) - 1 AS label_id,
          array_to_string(regexp_extract_all(text, '{TOKEN}'), ' ') AS toks,
          len(regexp_extract_all(text, '{TOKEN}')) AS n_items FROM documents""",
}

# The same rows by another way.
ORACLE["span_join"] = ORACLE["span_match"]
ORACLE["read_numbered"] = ORACLE["read_corpus"]
ORACLE["read_knowledge_split"] = ORACLE["read_knowledge"]
ORACLE["retrieve_topk_index"] = ORACLE["retrieve_topk"]
ORACLE["retrieval_replay_index"] = ORACLE["retrieval_replay"]
ORACLE["stream_replay"] = ORACLE["retrieval_replay"]
ORACLE["refresh_record"] = ORACLE["embed_corpus"]
ORACLE["stream_best"] = steps(
    ["epochs"],
    """SELECT a.run, a.epoch, round(a.value, 6) AS valid, round(b.value, 6) AS test, round(greatest(a.value, 0), 6) AS best
    FROM (SELECT * FROM epochs WHERE metric = 'view' QUALIFY row_number() OVER (PARTITION BY run ORDER BY value DESC, epoch) = 1) a
    LEFT JOIN epochs b ON a.run = b.run AND a.epoch = b.epoch AND b.metric = 'purchase'""",
)
