"""The same queries as plain SQL for an independent engine, over the same tables."""

from __future__ import annotations

from offramp.operators.chat import BOS
from offramp.plans.catalog import EOS, MAX_LEN, MIXER, PAD, THRESHOLDS, UNK, VOCAB
from offramp.plans.inputs import (EXITS, FULL_LAYER, IGNORE_EVERY, LAYERS, POSITIONS, ROTATED_BY, ROTATIONS,
                                  SEQUENCES_PER_BATCH, TOKEN_CLASSES)


def _norm(col: str) -> str:
    return f"trim(regexp_replace(lower({col}), '[ \\t\\n\\r\\f]+', ' ', 'g'))"


def _hash(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}::VARCHAR), 1, 8))::BIGINT"


def _trim(col: str) -> str:
    return f"regexp_replace({col}, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')"


def _rendered(role: str, content: str) -> str:
    return (f"'<|start_header_id|>' || {role} || '<|end_header_id|>' || chr(10) || chr(10) || "
            f"{_trim(content)} || '<|eot_id|>'")


PROMPT = "'Write a text in ' || lang || ' for ' || source"
EMPTY_SYSTEM = _rendered("'system'", "''")
TEMPLATED = f"'{BOS}' || {_rendered(repr('user'), PROMPT)} || {_rendered(repr('assistant'), 'text')}"
TEMPLATED_SYSTEM = (f"'{BOS}' || {EMPTY_SYSTEM} || {_rendered(repr('user'), PROMPT)} || "
                    f"{_rendered(repr('assistant'), 'text')}")
MIXED = " OR ".join(f"(lang = '{lang}' AND {_hash('doc_id')} < {int(f * 2 ** 32)})"
                    for lang, f in MIXER.items())

HITS = f"""hits AS (SELECT DISTINCT d.doc_id FROM (SELECT doc_id, {_norm('text')} AS t FROM documents) d
    JOIN (SELECT {_norm('text')} AS b FROM benchmark) b ON contains(d.t, b.b))"""


def _templated_hits(text: str) -> str:
    return f"""t AS (SELECT doc_id, lang, {text} AS text FROM documents),
    hits AS (SELECT DISTINCT d.doc_id FROM (SELECT doc_id, {_norm('text')} AS t FROM t) d
    JOIN (SELECT {_norm('text')} AS b FROM benchmark) b ON contains(d.t, b.b))"""


ASKED = "'Question q' || doc_id || ' has its answer in the archive of ' || lang || (doc_id % 9)"
LARGE_BENCHMARK = """items AS (SELECT text AS b FROM benchmark UNION
    SELECT 'q' || (doc_id * 7) || ' has its answer in the archive of ' || lang || j FROM documents, range(1, 6) r(j))"""


def _large_hits(text: str) -> str:
    return f"""t AS (SELECT doc_id, {text} AS text FROM documents), {LARGE_BENCHMARK},
    hits AS (SELECT DISTINCT d.doc_id FROM (SELECT doc_id, {_norm('text')} AS t FROM t) d
    JOIN (SELECT {_norm('b')} AS b FROM items) b ON contains(d.t, b.b))"""


# Conversations: messages in order, with an empty system message where none is first.
TURNS = "turns AS (SELECT conv_id, turn, role, text FROM conversations)"
SYSTEM_TURNS = """turns AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
    SELECT conv_id, -1, 'system', '' FROM conversations WHERE turn = 0 AND role <> 'system')"""
LISTED = "md5(string_agg(role || chr(31) || text, chr(30) ORDER BY turn))"

# Tokens: every word of every document with its place and id.
VOCABULARY = f"""w AS (SELECT doc_id, string_split_regex(text, '[ \\t\\n\\r\\f]+') AS w FROM documents),
    tok AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM w),
    cnt AS (SELECT token, count(*) AS n FROM tok WHERE token NOT IN ('<unk>', '<eos>', '<pad>') GROUP BY token
        ORDER BY n DESC, token LIMIT {VOCAB - 3}),
    vocab AS (SELECT '<unk>' AS token, 0 AS token_id, 0 AS n UNION ALL SELECT '<eos>', 1, 0
        UNION ALL SELECT '<pad>', 2, 0 UNION ALL
        SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 2)::INTEGER, n FROM cnt)"""
ENCODED = f"""{VOCABULARY},
    enc AS (SELECT doc_id, i, coalesce(token_id, {UNK}) AS id FROM tok LEFT JOIN vocab USING (token))"""
PADDED = f"""{ENCODED},
    cut AS (SELECT doc_id, ((i - 1) // {MAX_LEN})::INTEGER AS part, (i - 1) % {MAX_LEN} + 1 AS i, id FROM enc),
    grid AS (SELECT doc_id, part, i, id, CASE WHEN id IS NULL THEN 0 ELSE 1 END AS m FROM
        (SELECT DISTINCT doc_id, part, unnest(range(1, {MAX_LEN + 1})) AS i FROM cut) LEFT JOIN cut USING (doc_id, part, i))"""

# Hidden states, heads and logits; one row per (position, exit, token).
HIDDEN = f"""hid AS (SELECT vec_id, vec_id // {POSITIONS} AS seq_id, (vec_id % {POSITIONS})::INTEGER AS pos,
        vec_id // {POSITIONS * SEQUENCES_PER_BATCH} AS batch_id, k AS exit_layer, label,
        list_transform(embedding[1:k], lambda x: x::DOUBLE) AS h
        FROM embeddings, (SELECT unnest([{', '.join(map(str, LAYERS))}]) AS k))"""
NORMED = f"""{HIDDEN},
    rms AS (SELECT *, 1.0 / sqrt(list_dot_product(h, h) / len(h) + 1e-6) AS r FROM hid),
    nrm AS (SELECT * EXCLUDE (h, r), list_transform(h, lambda x: x * r) AS v FROM rms)"""
HEADS = f"""{NORMED},
    hd AS (SELECT exit_layer, label AS token_id, i, avg(v[i]) AS w FROM nrm, range(1, {FULL_LAYER + 1}) g(i)
        WHERE i <= exit_layer GROUP BY ALL),
    head AS (SELECT exit_layer, token_id, list(w ORDER BY i) AS w FROM hd GROUP BY ALL)"""
LOGITS = f"""{HEADS},
    lg AS (SELECT seq_id, pos, batch_id, n.exit_layer, label, vec_id, token_id,
        list_dot_product(v, w) AS logit FROM nrm n JOIN head USING (exit_layer)),
    mx AS (SELECT *, max(logit) OVER p AS m FROM lg WINDOW p AS (PARTITION BY vec_id, exit_layer)),
    z AS (SELECT *, m + ln(sum(exp(logit - m)) OVER (PARTITION BY vec_id, exit_layer)) AS lse FROM mx),
    lp AS (SELECT *, logit - lse AS log_p FROM z)"""
_KL_ROWS = f""",
    klr AS (SELECT s.batch_id, s.seq_id, s.pos, s.exit_layer, sum(exp(t.log_p) * (t.log_p - s.log_p)) AS kl
        FROM lp s JOIN lp t ON s.vec_id = t.vec_id AND s.token_id = t.token_id AND t.exit_layer = {FULL_LAYER}
        WHERE s.exit_layer <> {FULL_LAYER} GROUP BY ALL)"""
KL_ROWS = LOGITS + _KL_ROWS
_LOSSES = """,
    kl AS (SELECT batch_id, exit_layer, sum(kl) / count(DISTINCT seq_id) AS kl_loss FROM klr GROUP BY ALL),
    ce AS (SELECT batch_id, exit_layer, avg(-log_p) AS ce_loss FROM lp WHERE token_id = label GROUP BY ALL),
    losses AS (SELECT batch_id, exit_layer, ce_loss, kl_loss FROM ce LEFT JOIN kl USING (batch_id, exit_layer)),
    means AS (SELECT batch_id, avg(ce_loss) AS ce_mean, avg(kl_loss) AS kl_mean FROM losses GROUP BY batch_id)"""
LOSSES = KL_ROWS + _LOSSES
PREDICTED = f"""{LOGITS},
    pred AS (SELECT seq_id, pos, exit_layer, label, token_id AS token, exp(log_p) AS confidence FROM lp
        QUALIFY row_number() OVER (PARTITION BY vec_id, exit_layer ORDER BY logit DESC, token_id) = 1)"""
_DECIDED = f"""
    dec AS (SELECT threshold, seq_id, pos, exit_layer AS chosen_exit, token, confidence, label FROM pred, th
        WHERE confidence > threshold OR exit_layer = {FULL_LAYER}
        QUALIFY row_number() OVER (PARTITION BY threshold, seq_id, pos ORDER BY exit_layer) = 1),
    stat AS (SELECT threshold, chosen_exit, count(*) AS positions,
        avg(CASE WHEN token = label THEN 1.0 ELSE 0.0 END) AS accuracy FROM dec GROUP BY ALL),
    tot AS (SELECT threshold, count(*) AS total, avg(chosen_exit) AS mean_layers FROM dec GROUP BY ALL),
    stats AS (SELECT threshold, chosen_exit, positions, round(positions / total, 4) AS share,
        round(accuracy, 4) AS accuracy, round(mean_layers, 4) AS mean_layers,
        round(1.0 - mean_layers / {FULL_LAYER}, 4) AS compute_saved FROM stat JOIN tot USING (threshold))"""

DECIDED = f"""{PREDICTED},
    th AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}])::DOUBLE AS threshold), {_DECIDED}"""
CURVE = f"""{PREDICTED}, th AS (SELECT (i / 1000.0)::DOUBLE AS threshold FROM range(1000) r(i)), {_DECIDED}"""

# The same with a head of 2,000 tokens and learned norms; the target is the vector's own class.
VOCABULARY_LOGITS = f"""{NORMED},
    nw AS (SELECT i, avg(abs(embedding[i]::DOUBLE) * 8.0) AS w FROM embeddings, range(1, {FULL_LAYER + 1}) g(i) GROUP BY i),
    wts AS (SELECT list(w ORDER BY i) AS weight FROM nw),
    hd AS (SELECT exit_layer, vec_id % {TOKEN_CLASSES} AS c, i, avg(v[i]) AS w FROM nrm, range(1, {FULL_LAYER + 1}) g(i)
        WHERE i <= exit_layer GROUP BY ALL),
    cls AS (SELECT exit_layer, c, list(w ORDER BY i) AS w FROM hd GROUP BY ALL),
    head AS (SELECT exit_layer, (c * {ROTATIONS} + j)::INTEGER AS token_id,
        list_concat(w[{ROTATED_BY} * j + 1:], w[1:{ROTATED_BY} * j]) AS w FROM cls, range(0, {ROTATIONS}) r(j)),
    own AS (SELECT * EXCLUDE (v), list_transform(v, lambda x, i: x * weight[i]) AS v FROM nrm, wts),
    lg AS (SELECT seq_id, pos, batch_id, n.exit_layer, vec_id, (vec_id % {TOKEN_CLASSES}) * {ROTATIONS} AS label, token_id,
        list_dot_product(v, w) AS logit FROM own n JOIN head USING (exit_layer)),
    mx AS (SELECT *, max(logit) OVER p AS m FROM lg WINDOW p AS (PARTITION BY vec_id, exit_layer)),
    z AS (SELECT *, m + ln(sum(exp(logit - m)) OVER (PARTITION BY vec_id, exit_layer)) AS lse FROM mx),
    lp AS (SELECT *, logit - lse AS log_p FROM z)"""

CE_NAMES = ", ".join(f"round(max(ce_loss) FILTER (exit_layer = {k}), 4) AS ce_loss_{k}" for k in LAYERS)
KL_NAMES = ", ".join(f"round(max(kl_loss) FILTER (exit_layer = {k}), 4) AS kl_loss_{k}" for k in EXITS)

_METRIC_ROWS = f"""WITH {LOSSES}, m AS (
        SELECT batch_id, exit_layer, 'ce_loss' AS metric, ce_loss AS value FROM losses UNION ALL
        SELECT batch_id, exit_layer, 'kl_loss', kl_loss FROM losses WHERE kl_loss IS NOT NULL),
    r AS (SELECT 'a' AS run_id, * FROM m UNION ALL SELECT 'b', * REPLACE (value * 2 AS value) FROM m)"""
METRIC_WINDOW = f"""{_METRIC_ROWS}
    SELECT run_id, batch_id // 10 AS "window", metric || '_' || exit_layer AS metric, round(avg(value), 4) AS value,
    count(value) AS n FROM r GROUP BY ALL"""
ENDED_WINDOWS = f"""{_METRIC_ROWS},
    s AS (SELECT run_id, batch_id // 2 AS "window", metric || '_' || exit_layer AS metric, value,
        max(batch_id) OVER (PARTITION BY run_id, metric, exit_layer) // 2 AS open FROM r)
    SELECT run_id, "window", metric, round(avg(value), 4) AS value, count(value) AS n FROM s
    WHERE "window" < open GROUP BY ALL"""
BATCH_PLAN = """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
        SELECT doc_id, i AS index, i // 64 AS step, (i // 32) % 2 AS micro_step, (i // 4) % 8 AS rank, i % 4 AS slot
        FROM r"""
DECONTAMINATED = f"""WITH {HITS} SELECT doc_id, lang, n_chars FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM hits)"""
ENCODE = f"""WITH {ENCODED} SELECT doc_id, count(*) AS n, md5(string_agg(id::VARCHAR, ',' ORDER BY i)) AS ids_md5
    FROM enc GROUP BY doc_id"""
EARLY_EXIT = f"""WITH {DECIDED} SELECT seq_id, pos, chosen_exit, token, round(confidence, 4) AS confidence
    FROM dec WHERE threshold = 0.3"""
SPLIT = f"""SELECT doc_id, lang, CASE WHEN {_hash('doc_id')} < {int(0.1 * 2 ** 32)} THEN 'test' ELSE 'train' END
    AS split FROM documents"""

ORACLE = {
    "scan_project": "SELECT doc_id, lang, n_chars FROM documents",
    "mix_sources": f"SELECT doc_id, lang, n_chars FROM documents WHERE {MIXED}",
    "mix_by_column": f"SELECT doc_id, lang, n_chars FROM documents WHERE {MIXED}",
    "write_shards": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents",
    "write_shards_sized": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents",
    "prepare_or_load": f"SELECT doc_id, md5({TEMPLATED}) AS text_md5 FROM documents",
    "stream_examples": "SELECT doc_id, lang, n_chars FROM documents",
    "write_metrics": """SELECT 'events' AS run_id, event_type AS metric, count(*) AS n,
        round(avg(value), 4) AS value FROM events GROUP BY event_type""",
    "messages": f"""SELECT doc_id, 2::BIGINT AS n, md5('user' || chr(31) || {PROMPT} || chr(30) ||
        'assistant' || chr(31) || text) AS messages_md5 FROM documents""",
    "conversation_messages": f"""WITH {TURNS} SELECT conv_id, turn // 1024 AS part, count(*) AS n,
        {LISTED} AS messages_md5 FROM turns GROUP BY ALL""",
    "conversation_parts": f"""WITH {TURNS}, g AS (SELECT conv_id, turn // 3 AS part, count(*) AS n,
        {LISTED} AS messages_md5 FROM turns GROUP BY ALL)
        SELECT conv_id, part, part = 0 AS is_first, part = max(part) OVER (PARTITION BY conv_id) AS is_last,
        n, messages_md5 FROM g""",
    "system_msg": f"WITH {SYSTEM_TURNS} SELECT conv_id, count(*) AS n, {LISTED} AS messages_md5 FROM turns GROUP BY conv_id",
    "chat_template": f"""WITH {SYSTEM_TURNS}, t AS (SELECT conv_id, '{BOS}' ||
        string_agg({_rendered('role', 'text')}, '' ORDER BY turn) AS text FROM turns GROUP BY conv_id)
        SELECT conv_id, 0::BIGINT AS part, length(text) AS n_chars, md5(text) AS text_md5 FROM t""",
    "chat_template_prompt": f"""WITH {TURNS} SELECT conv_id, 0::BIGINT AS part, md5('{BOS}' ||
        string_agg({_rendered('role', 'text')}, '' ORDER BY turn) ||
        '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)) AS text_md5
        FROM turns GROUP BY conv_id""",
    "trim_text": f"""WITH p AS (SELECT doc_id, ' ' || chr(9) || chr(13) || chr(10) || text || chr(11) || chr(12) ||
        ' ' || chr(10) AS t FROM documents)
        SELECT doc_id, length(t) AS n_before, md5({_trim('t')}) AS text_md5 FROM p""",
    "normalize": f"SELECT doc_id, md5({_norm('text')}) AS text_md5 FROM documents",
    "decontaminate": DECONTAMINATED,
    "decontaminate_join": DECONTAMINATED,
    "decontaminate_template": f"""WITH {_large_hits(f"{ASKED} || chr(10) || text")}
        SELECT doc_id, md5(text) AS text_md5 FROM t WHERE doc_id NOT IN (SELECT doc_id FROM hits)""",
    "stream_prepare_large": f"""WITH {_large_hits(f"'{BOS}' || {EMPTY_SYSTEM} || {_rendered(repr('user'), ASKED)} || {_rendered(repr('assistant'), 'text')}")}
        SELECT doc_id, md5(text) AS text_md5 FROM t WHERE doc_id NOT IN (SELECT doc_id FROM hits)""",
    "decon_report": f"""WITH {HITS} SELECT count(*) AS rows_before, count(h.doc_id) AS removed,
        count(*) - count(h.doc_id) AS kept, round(count(h.doc_id) / count(*) * 100.0, 4) AS removed_percent
        FROM documents d LEFT JOIN hits h USING (doc_id)""",
    "split": SPLIT,
    "select_split": f"SELECT * FROM ({SPLIT}) WHERE split = 'train'",
    "preview": """SELECT doc_id, text, lang, source, n_chars FROM documents
        ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 3""",
    "shuffle_rank": """SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) - 1 AS rank
        FROM documents""",
    "seeded_shuffle": """SELECT doc_id, lang,
        row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) - 1 AS place FROM documents""",
    "vocab": f"WITH {VOCABULARY} SELECT token, token_id, n FROM vocab",
    "encode": ENCODE,
    "encode_join": ENCODE,
    "pack": f"""WITH {ENCODED}, stream AS (SELECT id, row_number() OVER (ORDER BY doc_id, i) - 1 AS g FROM
        (SELECT doc_id, i, id FROM enc UNION ALL SELECT doc_id, 9223372036854775807, {EOS} FROM documents))
        SELECT g // {MAX_LEN} AS seq_id, count(*) AS n, md5(string_agg(id::VARCHAR, ',' ORDER BY g)) AS ids_md5
        FROM stream GROUP BY g // {MAX_LEN} HAVING count(*) = {MAX_LEN}""",
    "truncate": f"""WITH {ENCODED} SELECT doc_id, count(*) AS n, md5(string_agg(id::VARCHAR, ',' ORDER BY i)) AS ids_md5
        FROM enc WHERE i <= {MAX_LEN} GROUP BY doc_id""",
    "pad_mask": f"""WITH {PADDED} SELECT doc_id, part,
        md5(string_agg(coalesce(id, {PAD})::VARCHAR, ',' ORDER BY i)) AS ids_md5,
        md5(string_agg(m::VARCHAR, ',' ORDER BY i)) AS mask_md5 FROM grid GROUP BY doc_id, part""",
    "labels_shift": f"""WITH {PADDED}, lab AS (SELECT doc_id, part, i, coalesce(id, -100) AS l,
        coalesce(lead(id) OVER (PARTITION BY doc_id, part ORDER BY i), -100) AS t FROM grid)
        SELECT doc_id, part, md5(string_agg(l::VARCHAR, ',' ORDER BY i)) AS labels_md5,
        md5(string_agg(t::VARCHAR, ',' ORDER BY i)) AS targets_md5 FROM lab GROUP BY doc_id, part""",
    "positions": f"""WITH {ENCODED} SELECT doc_id, md5(string_agg((i + 2)::VARCHAR, ',' ORDER BY i)) AS positions_md5
        FROM enc GROUP BY doc_id""",
    "batch_plan": BATCH_PLAN,
    "cap_steps": f"{BATCH_PLAN} WHERE i // 64 < 5",
    "token_budget": f"""WITH {PADDED}, c AS (SELECT doc_id, part, count(*) AS n FROM cut GROUP BY doc_id, part)
        SELECT count(*) AS sequences, count(*) * {MAX_LEN} AS token_slots, sum(n)::BIGINT AS tokens,
        round(1.0 - sum(n) / (count(*) * {MAX_LEN}), 4) AS padding_share, count(*) // 64 AS steps_available,
        least(count(*) // 64, 3) AS steps_used FROM c""",
    "rms_norm": f"""WITH {NORMED} SELECT seq_id, pos, exit_layer, (generate_subscripts(v, 1) - 1)::INTEGER AS i,
        round(unnest(v), 4) AS value FROM nrm""",
    "exit_logits": f"WITH {LOGITS} SELECT seq_id, pos, exit_layer, token_id AS i, round(logit, 4) AS logit FROM lg",
    "exit_logits_tied": f"""WITH {HEADS}, wide AS (SELECT seq_id, pos, exit_layer, h,
        1.0 / sqrt(list_dot_product(h, h) / {FULL_LAYER} + 1e-6) AS r FROM hid)
        SELECT seq_id, pos, n.exit_layer, token_id AS i,
        round(list_dot_product(h, w[1:n.exit_layer]) * r, 4) AS logit
        FROM wide n, head WHERE head.exit_layer = {FULL_LAYER}""",
    "exit_head_stats": f"""WITH {KL_ROWS}, s AS (SELECT seq_id, pos, exit_layer,
        arg_min(token_id, (-logit, token_id)) AS token, max(lse) AS lse, max(logit) AS top,
        max(logit) FILTER (token_id = label) AS target_logit FROM lp GROUP BY seq_id, pos, exit_layer)
        SELECT seq_id, pos, exit_layer, token, round(lse, 4) AS lse, round(top, 4) AS top,
        round(target_logit, 4) AS target_logit, round(kl, 4) AS kl FROM s
        LEFT JOIN (SELECT seq_id, pos, exit_layer, kl FROM klr) USING (seq_id, pos, exit_layer)""",
    "exit_losses_stats": f"""WITH {LOSSES} SELECT batch_id, exit_layer, round(ce_loss, 4) AS ce_loss,
        round(kl_loss, 4) AS kl_loss FROM losses""",
    "early_exit_stats": EARLY_EXIT,
    "prune_depth": f"""WITH {HIDDEN} SELECT seq_id, pos, exit_layer,
        round(list_sum(list_transform(h, lambda x, i: x * i)), 4) AS weighed FROM hid WHERE exit_layer <= 32""",
    "last_positions": f"""WITH {HIDDEN} SELECT seq_id, pos, exit_layer FROM hid
        QUALIFY pos >= max(pos) OVER (PARTITION BY seq_id) - 1""",
    "virtual_tokens": f"WITH {HIDDEN} SELECT seq_id, pos - 3 AS pos, exit_layer, label FROM hid WHERE pos >= 3",
    "log_softmax": f"WITH {LOGITS} SELECT seq_id, pos, exit_layer, token_id AS i, round(log_p, 4) AS log_p FROM lp",
    "exit_ce": f"""WITH {LOGITS} SELECT exit_layer, round(avg(-log_p), 4) AS ce_loss, count(*) AS ce_positions
        FROM lp WHERE token_id = label GROUP BY exit_layer""",
    "exit_ce_shifted": f"""WITH {LOGITS}, lab AS (SELECT vec_id,
        lead(CASE WHEN vec_id % {IGNORE_EVERY} = 0 THEN -100 ELSE label END)
        OVER (PARTITION BY vec_id // {POSITIONS} ORDER BY vec_id) AS target FROM embeddings)
        SELECT batch_id, exit_layer, round(avg(-log_p), 4) AS ce_loss, count(*) AS ce_positions
        FROM lp JOIN lab USING (vec_id) WHERE token_id = target GROUP BY ALL""",
    "exit_kl": f"WITH {LOSSES} SELECT batch_id, exit_layer, round(kl_loss, 4) AS kl_loss FROM kl",
    "exit_kl_masked": f"""WITH {KL_ROWS} SELECT batch_id, exit_layer, round(avg(kl), 4) AS kl_loss
        FROM klr WHERE pos % 3 <> 0 GROUP BY ALL""",
    "mean_exit_loss": f"""WITH {LOSSES} SELECT batch_id, round(ce_mean, 4) AS ce_mean,
        round(kl_mean, 4) AS kl_mean FROM means""",
    "distill_loss": f"""WITH {LOSSES} SELECT batch_id, round(ce_mean, 4) AS ce_mean, round(kl_mean, 4) AS kl_mean,
        round(kl_mean + 0.5 * ce_mean, 4) AS loss FROM means""",
    "distill_loss_no_kl": f"""WITH {LOSSES} SELECT batch_id, round(ce_mean, 4) AS ce_mean, 0.0::DOUBLE AS kl_mean,
        round(0.5 * ce_mean, 4) AS loss FROM means""",
    "metric_pivot": f"WITH {LOSSES} SELECT batch_id AS step, {CE_NAMES}, {KL_NAMES} FROM losses GROUP BY batch_id",
    "metric_window": METRIC_WINDOW,
    "dataset_summary": """SELECT lang, source, count(*) AS rows,
        round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY ALL""",
    "exit_pred": f"WITH {PREDICTED} SELECT seq_id, pos, exit_layer, token, round(confidence, 4) AS confidence FROM pred",
    "exit_pred_top3": f"""WITH {LOGITS}, r AS (SELECT seq_id, pos, exit_layer, token_id, log_p,
        row_number() OVER (PARTITION BY vec_id, exit_layer ORDER BY logit DESC, token_id) - 1 AS i FROM lp)
        SELECT seq_id, pos, exit_layer, i::INTEGER AS i, token_id AS token, round(exp(log_p), 4) AS confidence
        FROM r WHERE i < 3""",
    "fixed_exit": f"""WITH {PREDICTED} SELECT seq_id, pos, exit_layer, token, round(confidence, 4) AS confidence
        FROM pred WHERE exit_layer IN (32, {FULL_LAYER})""",
    "early_exit": EARLY_EXIT,
    "exit_stats": f"WITH {DECIDED} SELECT * EXCLUDE (threshold) FROM stats WHERE threshold = 0.3",
    "exit_sweep": f"WITH {DECIDED} SELECT * FROM stats",
    "exit_curve": f"WITH {CURVE} SELECT * FROM stats",
    "invalid_exits": f"""WITH {HIDDEN} SELECT DISTINCT (label + 1) * 8 AS exit_layer FROM embeddings
        WHERE (label + 1) * 8 NOT IN (SELECT exit_layer FROM hid)""",
    "stream_prepare": f"""WITH {_templated_hits(TEMPLATED_SYSTEM)} SELECT doc_id, md5(text) AS text_md5 FROM t
        WHERE doc_id NOT IN (SELECT doc_id FROM hits)""",
    "stream_metrics": METRIC_WINDOW,
    "stream_metrics_ended": ENDED_WINDOWS,
    "map_examples": "SELECT doc_id, upper(lang) AS lang FROM documents",
    "filter_batches": "SELECT doc_id, n_chars FROM documents WHERE length(text) > 1000",
    "prepare_corpus": f"""WITH {_templated_hits(TEMPLATED_SYSTEM)} SELECT doc_id, md5(text) AS text_md5 FROM t
        WHERE ({MIXED}) AND doc_id NOT IN (SELECT doc_id FROM hits)""",
    "prepare_corpus_full": f"""WITH {_templated_hits(TEMPLATED_SYSTEM)} SELECT doc_id, md5(text) AS text_md5 FROM t
        WHERE doc_id NOT IN (SELECT doc_id FROM hits)""",
    "evaluate_step": f"""WITH {LOSSES}, wide AS (SELECT batch_id, {CE_NAMES}, {KL_NAMES} FROM losses GROUP BY batch_id)
        SELECT wide.*, round(ce_mean, 4) AS ce_mean, round(kl_mean, 4) AS kl_mean,
        round(kl_mean + 0.5 * ce_mean, 4) AS loss FROM wide JOIN means USING (batch_id)""",
    "evaluate_step_no_kl": f"""WITH {LOSSES}, wide AS (SELECT batch_id, {CE_NAMES} FROM losses GROUP BY batch_id)
        SELECT wide.*, round(ce_mean, 4) AS ce_mean, 0.0::DOUBLE AS kl_mean, round(0.5 * ce_mean, 4) AS loss
        FROM wide JOIN means USING (batch_id)""",
    "evaluate_step_teacher": f"""WITH {KL_ROWS},
        kl AS (SELECT batch_id, exit_layer, sum(kl) / count(DISTINCT seq_id) AS kl_loss FROM klr
            WHERE NOT (seq_id % 5 = 0 AND pos = 3) GROUP BY ALL),
        ce AS (SELECT batch_id, exit_layer, avg(-log_p) AS ce_loss FROM lp WHERE token_id = label
            AND NOT (exit_layer = {FULL_LAYER} AND seq_id % 5 = 0 AND pos = 3) GROUP BY ALL),
        losses AS (SELECT batch_id, exit_layer, ce_loss, kl_loss FROM ce LEFT JOIN kl USING (batch_id, exit_layer)),
        wide AS (SELECT batch_id, {CE_NAMES}, {KL_NAMES}, avg(ce_loss) FILTER (exit_layer <> {FULL_LAYER}) AS c,
            avg(kl_loss) AS k FROM losses GROUP BY batch_id)
        SELECT * EXCLUDE (c, k), round(c, 4) AS ce_mean, round(k, 4) AS kl_mean, round(k + 0.5 * c, 4) AS loss FROM wide""",
    "vocabulary_stats": f"""WITH {VOCABULARY_LOGITS} {_KL_ROWS}, s AS (SELECT seq_id, pos, exit_layer,
        arg_min(token_id, (-logit, token_id)) AS token, max(lse) AS lse, max(logit) AS top,
        max(logit) FILTER (token_id = label) AS target_logit FROM lp GROUP BY seq_id, pos, exit_layer)
        SELECT seq_id, pos, exit_layer, token, round(lse, 4) AS lse, round(top, 4) AS top,
        round(target_logit, 4) AS target_logit, round(kl, 4) AS kl FROM s
        LEFT JOIN (SELECT seq_id, pos, exit_layer, kl FROM klr) USING (seq_id, pos, exit_layer)""",
    "vocabulary_step": f"""WITH {VOCABULARY_LOGITS} {_KL_ROWS} {_LOSSES},
        wide AS (SELECT batch_id, {CE_NAMES}, {KL_NAMES} FROM losses GROUP BY batch_id)
        SELECT wide.*, round(ce_mean, 4) AS ce_mean, round(kl_mean, 4) AS kl_mean,
        round(kl_mean + 0.5 * ce_mean, 4) AS loss FROM wide JOIN means USING (batch_id)""",
    "vocabulary_exits": f"""WITH {VOCABULARY_LOGITS}, pred AS (SELECT seq_id, pos, exit_layer, token_id AS token,
        exp(log_p) AS confidence FROM lp
        QUALIFY row_number() OVER (PARTITION BY vec_id, exit_layer ORDER BY logit DESC, token_id) = 1)
        SELECT seq_id, pos, exit_layer AS chosen_exit, token, round(confidence, 4) AS confidence FROM pred
        WHERE confidence > 0.01 OR exit_layer = {FULL_LAYER}
        QUALIFY row_number() OVER (PARTITION BY seq_id, pos ORDER BY exit_layer) = 1""",
    "exit_report": f"""WITH {DECIDED}, c AS (SELECT exit_layer, round(avg(-log_p), 4) AS ce_loss FROM lp
        WHERE token_id = label GROUP BY exit_layer),
        k AS (SELECT s.exit_layer, round(sum(exp(t.log_p) * (t.log_p - s.log_p)) / count(DISTINCT s.seq_id), 4) AS kl_loss
        FROM lp s JOIN lp t ON s.vec_id = t.vec_id AND s.token_id = t.token_id AND t.exit_layer = {FULL_LAYER}
        WHERE s.exit_layer <> {FULL_LAYER} GROUP BY s.exit_layer),
        st AS (SELECT * FROM stats WHERE threshold = 0.3)
        SELECT c.exit_layer, ce_loss, kl_loss, coalesce(positions, 0) AS positions, coalesce(share, 0.0)::DOUBLE AS share,
        accuracy FROM c LEFT JOIN k USING (exit_layer) LEFT JOIN st ON st.chosen_exit = c.exit_layer""",
}
