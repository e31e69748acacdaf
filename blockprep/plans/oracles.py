"""The same results as ``registry.QUERIES`` in plain SQL over the given tables.

Written from the rules, not from the plans: a conversation is rendered as one
whole text, orders come from one global window, and so on.
"""

from __future__ import annotations

import re

from blockprep.config import SPECIAL_TOKENS
from blockprep.functions.text import STRIP_PATTERN, token_pattern
from blockprep.plans.registry import (
    ACCUMULATION,
    CFG,
    EXTRA_TOKEN,
    FILL_CFG,
    FOLD_PIECE,
    PACK_GROUPS,
    PACK_START,
    STEP_THRESHOLD,
    STEPS,
    TEMPERATURE,
    TOP_P,
)

L, BLOCK, SUB, SEED = CFG.context_length, CFG.block_size, CFG.sub_block_size, CFG.seed
PATTERN = token_pattern(CFG)
BYTES = 5 + CFG.vocab_size
RESERVED = ", ".join(f"'{t}'" for t, _ in SPECIAL_TOKENS)
RESERVED_ROWS = ", ".join(f"('{t}', {i}, true)" for t, i in SPECIAL_TOKENS)


def _rendered(role: str, content: str) -> str:
    return f"'<|im_start|>' || {role} || chr(10) || {content} || '<|im_end|>' || chr(10)"


def _with(parts: dict[str, str], final: str) -> str:
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in parts.items())
    return f"WITH {ctes}\n{final}"


def _vocab(counts: str) -> str:
    return f"""
      SELECT token, CAST(4 + rn AS INTEGER) AS token_id, false AS is_special
      FROM (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS rn
            FROM {counts} WHERE token NOT IN ({RESERVED}))
      WHERE rn <= {CFG.vocab_size}
      UNION ALL SELECT * FROM (VALUES {RESERVED_ROWS}) AS s(token, token_id, is_special)
      UNION ALL SELECT '<|one byte of a token that has no id: ' || printf('%02X', b) || '|>',
                       CAST({BYTES} + b AS INTEGER), false FROM range(256) AS r(b)"""


def _coded(tokens: str) -> str:
    """Each token's id, or the ids of its bytes where it has none."""
    return f"""
      SELECT sample_id, i, CASE WHEN token_id IS NOT NULL THEN [token_id] ELSE list_transform(range(strlen(token)),
               lambda k: CAST({BYTES} + ('0x' || substr(hex(encode(token)), CAST(2 * k + 1 AS BIGINT), 2))::BIGINT AS INTEGER)) END AS own
      FROM {tokens} LEFT JOIN (SELECT token, token_id FROM vocab) USING (token)"""


def _numbered(coded: str) -> str:
    return f"""
      SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY i, j) - 1 AS pos, token_id
      FROM (SELECT sample_id, i, unnest(own) AS token_id, generate_subscripts(own, 1) AS j FROM {coded})"""


# --- instruction rows ---------------------------------------------------------

INSTRUCTIONS = {
    "shape_a": """
      SELECT doc_id AS sample_id, generate_subscripts(lines, 1) - 1 AS ord, unnest(lines) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id % 3 = 0)""",
    "msgs": """
      SELECT sample_id, CAST(ord AS INTEGER) AS ord,
             CASE WHEN ord % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
             CASE WHEN line = '' THEN 'None' ELSE line END AS content
      FROM shape_a
      UNION ALL SELECT doc_id, 0, 'user', lang FROM documents WHERE doc_id % 3 = 1
      UNION ALL SELECT doc_id, 1, 'assistant', text FROM documents WHERE doc_id % 3 = 1
      UNION ALL SELECT doc_id, 2, 'system', source FROM documents WHERE doc_id % 3 = 1
      UNION ALL
      SELECT doc_id, 0, 'user',
             (CASE WHEN lang = 'en' THEN text ELSE source END)
             || (CASE WHEN source = 'src0' THEN '' ELSE chr(10) || chr(10) || lang END)
      FROM documents WHERE doc_id % 3 = 2
      UNION ALL SELECT doc_id, 1, 'assistant', source FROM documents WHERE doc_id % 3 = 2""",
    "rendered": f"""
      SELECT sample_id, string_agg({_rendered('role', 'content')}, '' ORDER BY ord) AS text
      FROM msgs GROUP BY sample_id""",
}

TOKENS = {
    "toks": f"""
      SELECT sample_id, generate_subscripts(t, 1) - 1 AS i, unnest(t) AS token
      FROM (SELECT sample_id, regexp_extract_all(text, '{PATTERN}', 1) AS t FROM rendered)""",
    "counts": "SELECT token, count(*) AS n FROM toks GROUP BY token",
    "vocab": _vocab("counts"),
    "early": f"SELECT * FROM toks WHERE i < {L}",
    "coded": _coded("early"),
    "numbered": _numbered("coded"),
    "cut": f"SELECT sample_id, pos, token_id FROM numbered WHERE pos < {L}",
    "ids": """
      SELECT sample_id, CAST(pos AS INTEGER) AS pos, CAST(token_id AS INTEGER) AS token_id FROM cut
      UNION ALL
      SELECT sample_id, CAST(count(*) AS INTEGER), 1 FROM cut GROUP BY sample_id
      HAVING max_by(token_id, pos) <> 1""",
}

INSTRUCTION_TOKENS = {**INSTRUCTIONS, **TOKENS}

# --- conversations ------------------------------------------------------------

CONVERSATIONS = {
    "rendered": f"""
      SELECT conv_id AS sample_id, string_agg({_rendered('role', 'text')}, '' ORDER BY turn) AS text
      FROM conversations GROUP BY conv_id""",
    **TOKENS,
}


ASKED = {
    "asked": f"""
      SELECT item_id AS sample_id, regexp_extract_all(
               {_rendered("'user'", 'text')} || '<|im_start|>assistant' || chr(10),
               '{PATTERN}', 1) AS t FROM benchmark""",
    "asked_tokens": """
      SELECT sample_id, generate_subscripts(t, 1) - 1 AS i, unnest(t) AS token FROM asked""",
    "asked_coded": _coded("asked_tokens"),
    "asked_numbered": _numbered("asked_coded"),
}


def _batches(samples: str, epoch: int = 0) -> str:
    return f"""
      SELECT sample_id, (rn - 1) // {CFG.micro_batch} AS batch_id,
             CAST((rn - 1) % {CFG.micro_batch} AS INTEGER) AS slot
      FROM (SELECT sample_id,
                   row_number() OVER (ORDER BY md5('{SEED}:{epoch}:' || sample_id), sample_id) AS rn
            FROM {samples})"""


def _coin(key: str, epoch: int = 0) -> str:
    return (
        f"CAST((('0x' || substr(md5('{SEED}:{epoch}:' || {key} || ':' || (pos // 32)), 1, 8))::BIGINT"
        " >> (pos % 32)) & 1 AS INTEGER)"
    )


PACKED = {
    **CONVERSATIONS,
    "batches": _batches("(SELECT DISTINCT conv_id AS sample_id FROM conversations)"),
    "lens": f"""
      SELECT sample_id, CAST((count(*) + {BLOCK - 1}) // {BLOCK} * {BLOCK} AS INTEGER) AS padded_len,
             count(*) AS n
      FROM ids WHERE pos < {L} GROUP BY sample_id""",
    "offsets": """
      SELECT sample_id, batch_id, slot, padded_len,
             CAST(sum(padded_len) OVER (PARTITION BY batch_id ORDER BY slot) - padded_len AS BIGINT)
               AS "offset"
      FROM batches JOIN lens USING (sample_id)""",
    "packed": f"""
      SELECT b.batch_id, CAST(p.pos AS INTEGER) AS pos, coalesce(r.token_id, 0) AS token_id
      FROM (SELECT DISTINCT batch_id FROM batches) b
      CROSS JOIN range({L}) p(pos)
      LEFT JOIN (SELECT batch_id, "offset" + pos AS pos, token_id
                 FROM ids JOIN offsets USING (sample_id) WHERE pos < {L}) r
        ON r.batch_id = b.batch_id AND r.pos = p.pos""",
    "coins": f"SELECT batch_id, pos, token_id, {_coin('batch_id')} AS coin FROM packed",
    "views": """
      SELECT batch_id, view, pos,
             CASE WHEN token_id <> 0 AND coin = 1 - view THEN 0 ELSE token_id END AS input_id,
             CASE WHEN token_id <> 0 AND coin = 1 - view THEN token_id ELSE -100 END AS label
      FROM coins CROSS JOIN (VALUES (0), (1)) v(view)""",
    "pairs": """
      SELECT batch_id, view, pos, ctx, label
      FROM (SELECT *, lag(input_id) OVER (PARTITION BY batch_id, view ORDER BY pos) AS ctx FROM views)
      WHERE pos >= 1 AND label <> -100""",
}

# --- scores -------------------------------------------------------------------


def _softmax(source: str, key: str, logit: str) -> str:
    return f"""
      SELECT {key}, token_id, e / sum(e) OVER (PARTITION BY {key}) AS prob
      FROM (SELECT {key}, token_id,
                   exp({logit} - max({logit}) OVER (PARTITION BY {key})) AS e FROM {source})"""


def _shares(source: str, key: str) -> str:
    window = f"OVER (PARTITION BY {key} ORDER BY prob DESC, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""
      SELECT {key}, token_id, prob,
             round(coalesce(sum(prob) {window} 1 PRECEDING), 0), 12) AS lo,
             round(sum(prob) {window} CURRENT ROW), 12) AS hi
      FROM {source}"""


def _kept(source: str, key: str) -> str:
    return f"""
      SELECT {key}, token_id, prob / sum(prob) OVER (PARTITION BY {key}) AS prob
      FROM {source} WHERE lo <= {TOP_P}"""


def _u(key: str) -> str:
    return f"('0x' || substr(md5('{SEED}:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


SCORES = {
    **PACKED,
    "pair_counts": "SELECT ctx, label, count(*) AS n FROM pairs GROUP BY ctx, label",
    "scores": """
      SELECT ctx, label AS token_id, ln(n::DOUBLE) AS logit FROM pair_counts
      WHERE label NOT IN (0, 3, 4)""",
    "plain": _softmax("scores", "ctx", "logit"),
    "best": """
      SELECT ctx, token_id, logit
      FROM (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY logit DESC, token_id) AS rn FROM scores)
      WHERE rn = 1""",
    "probs": _softmax("scores", "ctx", f"(logit / {TEMPERATURE})"),
    "shares": _shares("probs", "ctx"),
    "kept": _kept("shares", "ctx"),
    "kept_shares": _shares("kept", "ctx"),
}

ORDERS = {
    "scores": """
      SELECT l_orderkey, l_linenumber AS token_id, sum(l_quantity) / 10 AS logit
      FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "probs": _softmax("scores", "l_orderkey", "logit"),
    "shares": _shares("probs", "l_orderkey"),
    "kept": _kept("shares", "l_orderkey"),
}

FILLING = {
    **SCORES,
    "slots": "SELECT batch_id * 2 + view AS seq_id, pos, input_id AS token_id FROM views",
    "scored": """
      SELECT seq_id, pos, s.token_id, coalesce(b.token_id, 2) AS candidate, coalesce(p.prob, 0) AS prob
      FROM slots s LEFT JOIN best b ON b.ctx = s.token_id
      LEFT JOIN plain p ON p.ctx = b.ctx AND p.token_id = b.token_id""",
    "shifted": """
      SELECT seq_id, pos, token_id,
             coalesce(lag(candidate) OVER w, candidate) AS candidate,
             coalesce(lag(prob) OVER w, prob) AS prob
      FROM scored WINDOW w AS (PARTITION BY seq_id ORDER BY pos)""",
    "chosen": f"""
      SELECT seq_id, CAST(pos // {SUB} AS BIGINT) AS sub_block, pos, candidate,
             round(prob, 12) > {STEP_THRESHOLD}
               OR row_number() OVER (PARTITION BY seq_id, pos // {SUB}
                                     ORDER BY round(prob, 12) DESC, pos) = 1
               AS chosen
      FROM shifted WHERE token_id = 0""",
    "filled": """
      SELECT s.seq_id, s.pos,
             CASE WHEN c.chosen THEN c.candidate ELSE s.token_id END AS token_id
      FROM slots s LEFT JOIN chosen c ON c.seq_id = s.seq_id AND c.pos = s.pos""",
    "blocks": f"""
      SELECT seq_id * {L // BLOCK} + pos // {BLOCK} AS seq_id, pos,
             CASE WHEN token_id = 0 AND seq_id % 2 = 0 THEN 1 ELSE token_id END AS token_id
      FROM filled""",
    "eos": """
      SELECT seq_id, eos_pos
      FROM (SELECT seq_id, min(pos) FILTER (WHERE token_id = 1) AS eos_pos,
                   min(pos) FILTER (WHERE token_id = 0) AS mask_pos FROM blocks GROUP BY seq_id)
      WHERE eos_pos < coalesce(mask_pos, 1000000000)""",
}

# --- alias tables: each cell is filled up by the first surplus that reaches its lack -----


def _alias(source: str, key: str) -> dict[str, str]:
    return {
        "fills": f"""
          SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY token_id) - 1 AS cell,
                 count(*) OVER (PARTITION BY {key}) AS size,
                 round(prob * count(*) OVER (PARTITION BY {key}), 12) AS fill FROM {source}""",
        "light": f"""
          SELECT *, round(coalesce(sum(1 - fill) OVER (PARTITION BY {key} ORDER BY token_id), 0), 12) AS upto FROM fills WHERE fill <= 1""",
        "heavy": f"""
          SELECT *, round(sum(fill - 1) OVER w, 12) AS upto, lead(token_id) OVER w AS next_id, lead(prob) OVER w AS next_prob
          FROM fills WHERE fill > 1 WINDOW w AS (PARTITION BY {key} ORDER BY token_id)""",
        "last_heavy": f"SELECT {key}, max(token_id) AS token_id, arg_max(prob, token_id) AS prob FROM heavy GROUP BY {key}",
        "filled_up": f"""
          SELECT l.{key}, l.size, l.cell, l.token_id, l.prob, l.fill AS accept,
                 coalesce(h.token_id, z.token_id, l.token_id) AS alias_id, coalesce(h.prob, z.prob, l.prob) AS alias_prob
          FROM (SELECT *, round(upto - (1 - fill), 12) AS lack FROM light) l
          ASOF LEFT JOIN heavy h ON l.{key} = h.{key} AND l.lack <= h.upto
          LEFT JOIN last_heavy z ON z.{key} = l.{key}""",
        "given_up": f"""
          SELECT h.{key}, h.size, h.cell, h.token_id, h.prob,
                 CASE WHEN l.upto IS NULL OR next_id IS NULL THEN 1 ELSE round(1 - (l.upto - h.upto), 12) END AS accept,
                 coalesce(next_id, h.token_id) AS alias_id, coalesce(next_prob, h.prob) AS alias_prob
          FROM heavy h ASOF LEFT JOIN light l ON l.{key} = h.{key} AND h.upto < l.upto""",
        "alias_cells": "SELECT * FROM filled_up UNION ALL SELECT * FROM given_up",
    }


# --- filling, with every pass written out ------------------------------------------

SPAN, PART, NEW, LEAST = FILL_CFG.block_size, FILL_CFG.sub_block_size, FILL_CFG.max_new_tokens, FILL_CFG.threshold

NEIGHBOURS = {
    "around": f"""
      SELECT batch_id, view, pos, label, lag(input_id) OVER w AS l1, lag(input_id, 2) OVER w AS l2,
             CASE WHEN pos + 1 < ((pos - 1) // {BLOCK} + 1) * {BLOCK} THEN lead(input_id) OVER w END AS r1
      FROM views WINDOW w AS (PARTITION BY batch_id, view ORDER BY pos)""",
    "keyed": """
      SELECT unnest([{'depth': 0, 'ctx': ''}, {'depth': 1, 'ctx': l1::VARCHAR}, {'depth': 2, 'ctx': l1 || ',' || l2},
                     {'depth': 3, 'ctx': l1 || ',' || l2 || ',' || r1}]) AS c, label
      FROM around WHERE pos >= 1 AND label <> -100""",
    "backoff": "SELECT c.depth AS depth, c.ctx AS ctx, label, count(*) AS n FROM keyed WHERE c.ctx IS NOT NULL GROUP BY ALL",
}


def _steps(depth: int, sampled: bool) -> dict[str, str]:
    """Candidates by the deepest known context, and one table per step of two blocks."""
    parts = {
        **NEIGHBOURS,
        "scores": f"SELECT ctx, label AS token_id, ln(n::DOUBLE) AS logit FROM backoff WHERE label NOT IN (0, 3, 4) AND depth <= {depth}",
        "probs": _softmax("scores", "ctx", "logit"),
        "shares": _shares("probs", "ctx"),
    }
    if sampled:
        parts["kept"] = f"SELECT ctx, token_id, prob / sum(prob) OVER (PARTITION BY ctx) AS prob FROM shares WHERE lo <= {FILL_CFG.top_p}"
        parts.update(_alias("kept", "ctx"))
        parts["states"] = "SELECT DISTINCT ctx, size FROM alias_cells"
    else:
        parts["states"] = """
          SELECT ctx, token_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY prob DESC, token_id) AS rn FROM shares)
          WHERE rn = 1"""
    parts["s0"] = """
      SELECT sample_id AS seq_id, -p AS pos, coalesce(max(token_id) FILTER (WHERE back = p), 0) AS token_id, NULL::INTEGER AS step
      FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos DESC) AS back FROM asked_numbered)
      CROSS JOIN (VALUES (1), (2)) q(p) GROUP BY ALL"""
    now, base = 0, "0"
    for start in range(0, NEW, SPAN):
        end = min(start + SPAN, NEW)
        subs = -(-(end - start) // PART)
        complete = f"""SELECT seq_id FROM s{{}} WHERE pos >= 0 GROUP BY seq_id
          HAVING min(pos) FILTER (WHERE token_id = 1) < coalesce(min(pos) FILTER (WHERE token_id = 0), 1000000000)"""
        parts[f"s{now + 1}"] = f"""
          SELECT * FROM s{now} UNION ALL SELECT seq_id, p, 0, NULL FROM (SELECT DISTINCT seq_id FROM s{now}), range({start}, {end}) r(p)
          WHERE seq_id NOT IN ({complete.format(now)})"""
        now += 1
        for number in range(PART):
            pass_from = now
            for sub in range(subs):
                low, high = start + sub * PART, min(start + (sub + 1) * PART, end)
                step = f"(({base}) + {number * subs + sub})"
                deep = ["''", "l1::VARCHAR", "l1 || ',' || l2", "l1 || ',' || l2 || ',' || r1"][: depth + 1]
                joins = " ".join(f"LEFT JOIN states t{d} ON t{d}.ctx = {key}" for d, key in enumerate(deep))
                best = lambda c: "coalesce(" + ", ".join(f"t{d}.{c}" for d in reversed(range(depth + 1))) + ")"
                parts[f"a{now}"] = f"""
                  SELECT *, lag(token_id) OVER w AS l1, lag(token_id, 2) OVER w AS l2,
                         CASE WHEN pos > {start} AND pos + 1 < {end} THEN lead(token_id) OVER w END AS r1
                  FROM s{now} WINDOW w AS (PARTITION BY seq_id ORDER BY pos)"""
                masked = f"token_id = 0 AND pos >= {low} AND pos < {high} AND seq_id NOT IN ({complete.format(pass_from)})"
                if sampled:
                    u = f"(('0x' || substr(md5('{SEED}:' || {step} || ':' || seq_id || ':' || pos), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
                    parts[f"d{now}"] = f"""
                      SELECT seq_id, pos, {best('ctx')} AS ctx, {u} * {best('size')} AS place
                      FROM (SELECT * FROM a{now} WHERE {masked}) {joins}"""
                    parts[f"c{now}"] = f"""
                      SELECT seq_id, pos, CASE WHEN place - floor(place) < accept THEN token_id ELSE alias_id END AS candidate,
                             round(CASE WHEN place - floor(place) < accept THEN prob ELSE alias_prob END, 12) AS prob
                      FROM d{now} JOIN alias_cells c ON c.ctx = d{now}.ctx AND c.cell = floor(place)::BIGINT"""
                else:
                    parts[f"c{now}"] = f"""
                      SELECT seq_id, pos, {best('token_id')} AS candidate, round({best('prob')}, 12) AS prob
                      FROM (SELECT seq_id, pos, l1, l2, r1 FROM a{now} WHERE {masked}) {joins}"""
                parts[f"s{now + 1}"] = f"""
                  SELECT s.seq_id, s.pos, coalesce(candidate, token_id) AS token_id, CASE WHEN candidate IS NULL THEN step ELSE {step} END AS step
                  FROM s{now} s LEFT JOIN (SELECT * FROM c{now}
                    QUALIFY prob > {LEAST} OR row_number() OVER (PARTITION BY seq_id ORDER BY prob DESC, pos) = 1) USING (seq_id, pos)"""
                now += 1
        base = f"({base}) + (SELECT coalesce((max(step) - ({base})) // {subs} + 1, 0) * {subs} FROM s{now} WHERE pos >= {start})"
    parts["done"] = f"""
      SELECT seq_id, CAST(pos AS INTEGER) AS pos, CAST(token_id AS INTEGER) AS token_id, CAST(step AS INTEGER) AS step
      FROM s{now} LEFT JOIN (SELECT seq_id, min(pos) FILTER (WHERE token_id = 1) AS e, min(pos) FILTER (WHERE token_id = 0) AS m
                             FROM s{now} WHERE pos >= 0 GROUP BY seq_id) USING (seq_id)
      WHERE pos >= 0 AND (e IS NULL OR e > coalesce(m, 1000000000) OR pos <= e)"""
    return parts


# --- chat history -------------------------------------------------------------

HISTORY = {
    "typed": """
      SELECT conv_id, turn, role,
             CASE WHEN role = 'user' AND conv_id % 10 = 0 AND turn >= 5 THEN 'EXIT'
                  WHEN role = 'user' AND conv_id % 3 = 0 AND turn = 3 THEN ' Clear' || chr(10)
                  WHEN role = 'user' AND conv_id % 7 = 0 AND turn = 2 THEN ' ' || chr(9)
                  ELSE text END AS text
      FROM conversations""",
    "stripped": f"""
      SELECT conv_id, turn, role, regexp_replace(text, '{STRIP_PATTERN}', '', 'g') AS content
      FROM typed""",
    "marked": """
      SELECT *, sum((role = 'user' AND lower(content) = 'clear')::INT) OVER w AS epoch,
             max((role = 'user' AND lower(content) = 'exit')::INT) OVER w AS over
      FROM stripped WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "history": """
      SELECT conv_id, CAST(epoch AS BIGINT) AS epoch, turn,
             row_number() OVER (PARTITION BY conv_id, epoch ORDER BY turn) - 1 AS ord, role, content
      FROM marked
      WHERE over = 0 AND NOT (role = 'user' AND (content = '' OR lower(content) = 'clear'))""",
}

PAIRS = """
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
flat AS (
  SELECT doc_id, generate_subscripts(lines, 1) - 1 AS k, unnest(lines) AS line FROM d),
kept AS (
  SELECT doc_id, k, CASE WHEN k % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, line FROM flat
  WHERE k % 2 = 0 OR line <> ''
  UNION ALL SELECT doc_id, 1000000000, 'user', source FROM d)
SELECT doc_id AS sample_id,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS ord,
       role, line AS content
FROM kept"""

DOCUMENT_BATCHES = {"batches": _batches("(SELECT doc_id AS sample_id FROM documents)")}

def _moved(number: int, half: str, size: str) -> str:
    return f"('0x' || substr(md5('{SEED}:' || epoch || ':{number}:' || {half}), 1, 15))::BIGINT % {size}"


def _rounds(source: str) -> str:
    """One pass of six rounds over a grid of a rows and b columns, from (.., x) to (.., x)."""
    out = f"(SELECT *, x % a AS r, x // a AS c FROM {source})"
    for k in range(6):
        row, column = ("r", f"(c + {_moved(k, 'r', 'b')}) % b") if k % 2 == 0 else (f"(r + {_moved(k, 'c', 'a')}) % a", "c")
        out = f"(SELECT * REPLACE ({row} AS r, {column} AS c) FROM {out})"
    return f"(SELECT epoch, per_epoch, sample_id, n, a, b, c * a + r AS x FROM {out})"


STEP_PLAN = f"""
WITH RECURSIVE sizes AS (
  SELECT count(*) AS n, (count(*) + {CFG.micro_batch - 1}) // {CFG.micro_batch} AS per_epoch,
         least(4096, CAST(pow(2, ceil(log2(sqrt(count(*))))) AS BIGINT)) AS a FROM documents),
grid AS (SELECT *, (n + a - 1) // a AS b FROM sizes),
epochs AS (
  SELECT unnest(generate_series(0, ({STEPS * ACCUMULATION} + per_epoch - 1) // per_epoch - 1)) AS epoch, grid.* FROM grid),
numbered AS (
  SELECT epoch, per_epoch, doc_id AS sample_id, n, a, b, row_number() OVER (PARTITION BY epoch ORDER BY md5('{SEED}:index:' || doc_id), doc_id) - 1 AS x
  FROM documents CROSS JOIN epochs),
walk AS (
  SELECT * FROM {_rounds('numbered')}
  UNION ALL SELECT * FROM {_rounds('(SELECT * FROM walk WHERE x >= n)')}),
placed AS (
  SELECT epoch, sample_id, x, epoch * per_epoch + x // {CFG.micro_batch} AS micro FROM walk WHERE x < n)
SELECT micro // {ACCUMULATION} AS step, micro, CAST(epoch AS INTEGER) AS epoch,
       CAST(x % {CFG.micro_batch} AS INTEGER) AS slot, sample_id
FROM placed WHERE micro < {STEPS * ACCUMULATION}"""

# --- what files, hooks and settings change ------------------------------------

BOTH_SOURCES = {
    **INSTRUCTIONS,
    "asked": f"SELECT item_id AS sample_id, {_rendered("'user'", 'text')} || {_rendered("'assistant'", "''")} AS text FROM benchmark",
}


def _views_of(epoch: int) -> dict[str, str]:
    """The chain from batches on, for another epoch, under names of its own."""
    n = f"{{}}_{epoch}"
    swap = {k: n.format(k) for k in ("batches", "offsets", "packed", "coins", "views")}

    def own(sql: str) -> str:
        return re.sub(r"\b(batches|offsets|packed|coins|views)\b", lambda m: swap[m.group()], sql)

    parts = {**PACKED, "batches": _batches("(SELECT DISTINCT conv_id AS sample_id FROM conversations)", epoch)}
    parts["coins"] = f"SELECT batch_id, pos, token_id, {_coin('batch_id', epoch)} AS coin FROM packed"
    return {swap[k]: own(parts[k]) for k in swap}


STREAM_VIEWS = {
    **INSTRUCTION_TOKENS,
    "padded": f"""
      SELECT s.sample_id, CAST(p.pos AS INTEGER) AS pos, coalesce(i.token_id, 0) AS token_id
      FROM (SELECT DISTINCT sample_id FROM ids) s CROSS JOIN range({L}) p(pos)
      LEFT JOIN ids i ON i.sample_id = s.sample_id AND i.pos = p.pos""",
    "coins": f"SELECT sample_id, pos, token_id, {_coin('sample_id')} AS coin FROM padded",
}

_DIGEST_IDS = "md5(string_agg(token_id::VARCHAR, ' ' ORDER BY pos))"



def _texts(source: str, key: str, name: str = "text") -> str:
    """Ids (token_id by pos) to text: tokens and runs of bytes, whole characters only."""
    return f"""
      SELECT {key}, decode(unhex(replace(array_to_string(regexp_extract_all(
               coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE NOT is_special), ''),
               '([0-7]. |(?:C[2-9A-F]|D.) [89AB]. |E. [89AB]. [89AB]. |F[0-4] [89AB]. [89AB]. [89AB]. )'
             ), ''), ' ', ''))) AS {name}
      FROM (SELECT *, CASE WHEN token_id >= {BYTES} THEN printf('%02X ', token_id - {BYTES})
                           ELSE regexp_replace(hex(encode(token)), '(..)', '\\1 ', 'g') END AS h
            FROM {source} JOIN vocab USING (token_id)) GROUP BY {key}"""


def _fill(depth: int, sampled: bool) -> dict[str, str]:
    return {**PACKED, **ASKED, **_steps(depth, sampled)}


ORACLES: dict[str, str] = {
    "to_messages": _with(INSTRUCTIONS, "SELECT sample_id, ord, role, content FROM msgs"),
    "render_chat": _with(
        INSTRUCTIONS,
        "SELECT sample_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM rendered",
    ),
    "role_norm": """
        SELECT conv_id, turn,
               CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE 'system' END AS role
        FROM conversations""",
    "non_blank": _with(
        HISTORY, "SELECT conv_id, turn, content AS text FROM stripped WHERE content <> ''"
    ),
    "pairs_to_messages": PAIRS,
    "prompt_messages": f"""
        SELECT item_id, {_rendered("'user'", 'text')} || '<|im_start|>assistant' || chr(10) AS text
        FROM benchmark""",
    "fold_turns": f"""
        SELECT conv_id, ord // {FOLD_PIECE} AS piece, CAST(ord % {FOLD_PIECE} AS INTEGER) AS pos,
               role, text AS content
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord
              FROM conversations)""",
    "history_prompts": _with(
        HISTORY,
        """SELECT conv_id, turn, epoch, ord + 1 AS n_messages, content AS prompt
           FROM history WHERE role = 'user'""",
    ),
    "history_messages": _with(HISTORY, "SELECT * FROM history"),
    "token_split": f"""
        SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, '') = text AS lossless,
               md5(array_to_string(t, chr(1))) AS digest
        FROM (SELECT doc_id, text, regexp_extract_all(text, '{PATTERN}', 1) AS t FROM documents)""",
    "build_vocab": _with(INSTRUCTION_TOKENS, "SELECT * FROM vocab"),
    "ensure_token": _with(
        CONVERSATIONS,
        f"""SELECT * FROM vocab UNION ALL
            SELECT '{EXTRA_TOKEN}', CAST(max(token_id) + 1 AS INTEGER), true FROM vocab""",
    ),
    "suppressed_ids": _with(
        CONVERSATIONS,
        """SELECT DISTINCT token_id FROM vocab
           WHERE token IN ('|<MASK>|', '<|im_start|>', '<|im_end|>')""",
    ),
    "token_ids": _with(CONVERSATIONS, "SELECT * FROM ids"),
    "instruction_ids": _with(
        INSTRUCTION_TOKENS,
        f"""SELECT sample_id, CAST(count(*) AS INTEGER) AS n_ids, {_DIGEST_IDS} AS digest
            FROM ids GROUP BY sample_id""",
    ),
    "append_eos": _with(
        CONVERSATIONS,
        """SELECT sample_id, CAST(count(*) AS INTEGER) AS n_ids, max_by(token_id, pos) AS last_id
           FROM ids GROUP BY sample_id""",
    ),
    "pad_block": _with(
        PACKED,
        f"""SELECT sample_id, padded_len,
                   CAST(padded_len - n + m AS INTEGER) AS mask_tokens
            FROM lens JOIN (SELECT sample_id, count(*) FILTER (WHERE token_id = 0 AND pos < {L}) AS m
                            FROM ids GROUP BY sample_id) USING (sample_id)""",
    ),
    "prompt_ids": _with(
        {**CONVERSATIONS, **ASKED},
        "SELECT sample_id, CAST(pos AS INTEGER) AS pos, token_id FROM asked_numbered",
    ),
    "detokenize": _with(PACKED, _texts("packed", "batch_id")),
    "assign_batches": _with(DOCUMENT_BATCHES, "SELECT * FROM batches"),
    "step_plan": STEP_PLAN,
    "pack_offsets": _with(PACKED, "SELECT * FROM offsets"),
    "pack_context": _with(PACKED, "SELECT * FROM packed"),
    "mask_coins": _with(PACKED, "SELECT batch_id, pos, coin FROM coins"),
    "complementary_views": _with(PACKED, "SELECT * FROM views"),
    "flatten_views": _with(PACKED, "SELECT batch_id, view, pos, label FROM views"),
    "training_pairs": _with(PACKED, "SELECT * FROM pairs"),
    "batch_profile": _with(
        PACKED,
        """SELECT batch_id, view, CAST(count(*) AS INTEGER) AS positions,
                  CAST(count(*) FILTER (WHERE label <> -100) AS INTEGER) AS labelled,
                  CAST(count(*) FILTER (WHERE input_id <> 0) AS INTEGER) AS visible,
                  CAST(count(*) FILTER (WHERE input_id = 0 AND label = -100) AS INTEGER) AS padding
           FROM views GROUP BY batch_id, view""",
    ),
    "block_visibility": _with(
        PACKED,
        f"""SELECT batch_id, view, pos,
                   CAST(least({L}, (pos // {BLOCK} + 1) * {BLOCK}) AS INTEGER) AS visible_upto
            FROM views""",
    ),
    "prefix_visibility": _with(
        PACKED,
        f"""SELECT sample_id, CAST(q AS INTEGER) AS pos,
                   CAST(CASE WHEN q >= padded_len - {BLOCK} THEN padded_len ELSE q + 1 END AS INTEGER)
                     AS visible_upto
            FROM (SELECT sample_id, padded_len, unnest(range(padded_len)) AS q FROM lens)""",
    ),
    "context_counts": _with(SCORES, "SELECT * FROM pair_counts"),
    "suppress": _with(SCORES, "SELECT ctx, token_id, round(logit, 9) AS logit FROM scores"),
    "softmax": _with(SCORES, "SELECT ctx, token_id, round(prob, 9) AS prob FROM plain"),
    "argmax": _with(SCORES, "SELECT ctx, token_id, round(logit, 9) AS logit FROM best"),
    "nucleus": _with(SCORES, "SELECT ctx, token_id, round(prob, 9) AS prob FROM kept"),
    "weighted_draw": _with(
        SCORES,
        f"""SELECT ctx, token_id, round(prob, 9) AS prob FROM kept_shares
            WHERE lo <= {_u('ctx')} AND {_u('ctx')} < hi""",
    ),
    "gather": _with(
        SCORES,
        """SELECT ctx, token_id, round(prob, 9) AS prob
           FROM best JOIN plain USING (ctx, token_id)""",
    ),
    "scatter": _with(
        SCORES,
        """SELECT ctx, token_id, round(coalesce(kept.prob, 0), 9) AS prob
           FROM probs LEFT JOIN kept USING (ctx, token_id)""",
    ),
    "order_softmax": _with(ORDERS, "SELECT l_orderkey, token_id, round(prob, 9) AS prob FROM probs"),
    "order_argmax": _with(
        ORDERS,
        """SELECT l_orderkey, token_id, logit
           FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY logit DESC, token_id) AS rn
                 FROM scores) WHERE rn = 1""",
    ),
    "order_nucleus": _with(ORDERS, "SELECT l_orderkey, token_id, round(prob, 9) AS prob FROM kept"),
    "order_draw": _with(
        ORDERS,
        f"""SELECT l_orderkey, token_id, round(prob, 9) AS prob FROM shares
            WHERE lo <= {_u('l_orderkey')} AND {_u('l_orderkey')} < hi""",
    ),
    "shift_scores": _with(
        FILLING, "SELECT seq_id, pos, candidate, round(prob, 9) AS prob FROM shifted"
    ),
    "select_confident": _with(FILLING, "SELECT seq_id, sub_block, pos, chosen FROM chosen"),
    "fill_step": _with(FILLING, "SELECT * FROM filled"),
    "apply_fills": _with(FILLING, "SELECT * FROM filled"),
    "complete_eos": _with(FILLING, "SELECT * FROM eos"),
    "has_mask": _with(
        FILLING, "SELECT seq_id, bool_or(token_id = 0) AS has_mask FROM filled GROUP BY seq_id"
    ),
    "fill_leftovers": _with(
        FILLING,
        "SELECT seq_id, pos, CASE WHEN token_id = 0 THEN 1 ELSE token_id END AS token_id FROM filled",
    ),
    "trim_at_eos": _with(
        FILLING,
        """SELECT f.* FROM blocks f LEFT JOIN eos USING (seq_id)
           WHERE eos_pos IS NULL OR pos <= eos_pos""",
    ),
    "response_only": _with(
        PACKED,
        """SELECT p.batch_id AS seq_id, pos, token_id
           FROM packed p JOIN offsets o ON o.batch_id = p.batch_id AND o.slot = 0
           WHERE pos >= padded_len""",
    ),
    "render_state": _with(
        FILLING,
        """SELECT seq_id, pos,
                  CASE WHEN token_id = 0 THEN '[MASK]' WHEN is_special THEN '' ELSE token END AS shown,
                  CASE WHEN token_id = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS score
           FROM slots JOIN vocab USING (token_id)""",
    ),
    "fill_final": _with(_fill(1, False), "SELECT * FROM done"),
    "fill_sampled": _with(_fill(1, True), "SELECT * FROM done"),
    "fill_sequence": _with(_fill(3, False), "SELECT * FROM done"),
    "fill_sequence_sampled": _with(_fill(3, True), "SELECT * FROM done"),
    "answer_texts": _with(
        {**_fill(1, True), "texts": _texts("done", "seq_id", "raw")},
        f"SELECT seq_id AS sample_id, regexp_replace(raw, '{STRIP_PATTERN}', '', 'g') AS answer FROM texts",
    ),
    "context_backoff": _with({**PACKED, **NEIGHBOURS}, "SELECT CAST(depth AS INTEGER) AS depth, ctx, label, n FROM backoff"),
    "alias_tables": _with(
        {**SCORES, **_alias("kept", "ctx")},
        """SELECT ctx, size, CAST(cell AS INTEGER) AS cell, token_id, round(prob, 9) AS prob, round(accept, 9) AS accept,
                  alias_id, round(alias_prob, 9) AS alias_prob FROM alias_cells""",
    ),
    "order_alias": _with(
        {**ORDERS, **_alias("probs", "l_orderkey")},
        """SELECT l_orderkey, size, CAST(cell AS INTEGER) AS cell, token_id, round(accept, 9) AS accept, alias_id FROM alias_cells""",
    ),
    "files_win": _with(
        BOTH_SOURCES,
        """SELECT 'files' AS source, sample_id, md5(text) AS digest FROM rendered
           UNION ALL SELECT 'dataset', sample_id, md5(text) FROM asked""",
    ),
    "large_array": _with(INSTRUCTIONS, "SELECT sample_id, md5(text) AS digest FROM rendered"),
    "saved_count": "SELECT count(*) AS n_saved, count(*) AS n_read FROM documents",
    "stored_epochs": _with(
        {**PACKED, **_views_of(1)},
        "SELECT CAST(0 AS INTEGER) AS epoch, * FROM views UNION ALL SELECT CAST(1 AS INTEGER), * FROM views_1",
    ),
    "stamp_check": f"""
        SELECT CAST(4 * ((count(DISTINCT conv_id) + {CFG.micro_batch - 1}) // {CFG.micro_batch}) AS BIGINT) AS n_views, settings, fits
        FROM conversations, (VALUES ('same', true), ('other mask', false), ('other block', false),
                                    ('other base', false), ('no stamp', false)) c(settings, fits)
        GROUP BY settings, fits""",
    "supplied_ids": _with(
        CONVERSATIONS, "SELECT '3 4 ' || (max(token_id) + 1) || ' ' || (max(token_id) + 2) || ' ' || (max(token_id) + 3) AS ids FROM vocab"
    ),
    "supplied_token_ids": _with(
        CONVERSATIONS,
        f"""SELECT sample_id, {_DIGEST_IDS} AS digest FROM (
              SELECT sample_id, pos, CASE WHEN token_id = 0 THEN (SELECT max(token_id) + 3 FROM vocab) ELSE token_id END AS token_id FROM ids)
            GROUP BY sample_id""",
    ),
    "guard_pad": _with(
        FILLING,
        """SELECT settings, pad_id, seq_id, pos, CAST(CASE WHEN token_id = 0 THEN spare ELSE token_id END AS INTEGER) AS token_id
           FROM filled CROSS JOIN (VALUES ('default', 1, 1), ('pad', 7, 7), ('pad beside end', 7, 1)) c(settings, pad_id, spare)""",
    ),
    "append_block": _with(
        {**CONVERSATIONS, **ASKED},
        f"""SELECT sample_id AS seq_id, CAST(pos AS INTEGER) AS pos, 0 AS token_id, false AS finished, CAST(n AS INTEGER) AS n_seen
            FROM (SELECT sample_id, count(*) AS n FROM asked_numbered GROUP BY sample_id), range({SPAN}, {NEW}) r(pos)""",
    ),
    "fill_log": _with(_fill(3, False), "SELECT seq_id, step, pos, token_id FROM done WHERE step IS NOT NULL"),
    "fill_states": _with(
        _fill(3, False),
        """SELECT CAST(s AS INTEGER) AS after, seq_id, pos, CAST(CASE WHEN step <= s THEN token_id ELSE 0 END AS INTEGER) AS token_id
           FROM done CROSS JOIN (VALUES (0), (1), (3)) q(s)""",
    ),
    "tailed_log": _with(_fill(1, False), "SELECT seq_id, step, pos, token_id FROM done WHERE step IS NOT NULL"),
    "stream_rejects": "SELECT '{broken ' || source AS line, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY source",
    "stream_packed": _with(
        {
            **INSTRUCTION_TOKENS,
            "own": f"""
              SELECT sample_id, pos, token_id FROM ids WHERE pos < {L}
              UNION ALL SELECT sample_id, unnest(range(n, (n + {BLOCK - 1}) // {BLOCK} * {BLOCK})), 0
              FROM (SELECT sample_id, count(*) AS n FROM ids WHERE pos < {L} GROUP BY sample_id)""",
            "grouped": f"""
              SELECT doc_id AS sample_id, ({PACK_START} + 60 * doc_id) // 7200 * 7200 AS start,
                     ('0x' || substr(md5('{SEED}:group:' || doc_id), 1, 8))::BIGINT % {PACK_GROUPS} AS part FROM documents""",
            "placed": f"""
              SELECT *, (row_number() OVER (PARTITION BY start, part ORDER BY md5('{SEED}:pack:' || sample_id), sample_id) - 1) AS place
              FROM grouped""",
            "joined": f"""
              SELECT start || '-' || part || '-' || place // {CFG.micro_batch} AS batch_id, token_id,
                     row_number() OVER (PARTITION BY start, part, place // {CFG.micro_batch} ORDER BY place, pos) - 1 AS k
              FROM placed JOIN own USING (sample_id)""",
            "filled": f"""
              SELECT batch_id, k, token_id FROM joined WHERE k < {L}
              UNION ALL SELECT batch_id, unnest(range(n, {L})), 0 FROM (SELECT batch_id, count(*) AS n FROM joined GROUP BY batch_id) WHERE n < {L}""",
        },
        """SELECT batch_id, CAST(count(*) AS INTEGER) AS n_ids, md5(string_agg(token_id::VARCHAR, ' ' ORDER BY k)) AS digest
           FROM filled GROUP BY batch_id""",
    ),
    "hooked_ids": f"""
        SELECT doc_id AS sample_id, CAST(len(ids) AS INTEGER) AS n_ids, md5(array_to_string(ids, ' ')) AS digest
        FROM (SELECT doc_id, list_append(list_transform(range(least(strlen(text), {L})),
                lambda k: 5 + ('0x' || substr(hex(encode(text)), CAST(2 * k + 1 AS BIGINT), 2))::BIGINT), 1) AS ids FROM documents)""",
    "heavy_lookup": _with(
        CONVERSATIONS,
        f"""SELECT doc_id, count(*) AS n_tokens, count(token_id) AS n_known, CAST(sum(token_id) AS BIGINT) AS id_sum
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{PATTERN}', 1)) AS token FROM documents)
            LEFT JOIN vocab USING (token) GROUP BY doc_id""",
    ),
    "large_vocab": f"""
        SELECT token, CAST(4 + row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS token_id, false AS is_special
        FROM (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{PATTERN}', 1)) AS token FROM documents)
              WHERE token NOT IN ({RESERVED}) GROUP BY token)
        UNION ALL SELECT * FROM (VALUES {RESERVED_ROWS}) AS s(token, token_id, is_special)""",
    "instructions_round_trip": _with(INSTRUCTIONS, "SELECT sample_id, ord, role, content FROM msgs"),
    "rows_without_ids": _with(
        INSTRUCTIONS,
        """SELECT md5(r.text) AS digest, row_number() OVER (
                    PARTITION BY doc_id % 3, d.text, lang, source ORDER BY doc_id) - 1 AS copy,
                  CAST(32 AS INTEGER) AS id_chars
           FROM rendered r JOIN documents d ON d.doc_id = r.sample_id""",
    ),
    "rejected_lines": """
        SELECT CASE doc_id % 5 WHEN 0 THEN '123' WHEN 1 THEN '"txt"' WHEN 2 THEN '[1]' WHEN 3 THEN '{broken'
                    ELSE 'taken' END AS line, count(*) AS n
        FROM documents GROUP BY ALL""",
    "lossless_ids": """
        SELECT doc_id AS sample_id, md5('user' || chr(10) || text || chr(10)) AS digest FROM documents""",
    "select_split": _with(
        INSTRUCTIONS,
        "SELECT sample_id, md5(text) AS digest FROM rendered WHERE sample_id % 5 <> 0",
    ),
    "stream_ingest": _with(
        INSTRUCTIONS,
        "SELECT sample_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM rendered",
    ),
    "stream_views": _with(
        STREAM_VIEWS,
        """SELECT sample_id, view,
                  md5(string_agg((CASE WHEN token_id <> 0 AND coin = 1 - view THEN 0 ELSE token_id END)
                                 ::VARCHAR, ' ' ORDER BY pos)) AS inputs,
                  md5(string_agg((CASE WHEN token_id <> 0 AND coin = 1 - view THEN token_id ELSE -100 END)
                                 ::VARCHAR, ' ' ORDER BY pos)) AS labels
           FROM coins CROSS JOIN (VALUES (0), (1)) v(view) GROUP BY sample_id, view""",
    ),
}
