"""SQL twins of the queries, for DuckDB: the definitions, written out over sets of words and windows rather than the way that Spark goes."""

from __future__ import annotations

import re

W = r"list_filter(string_split_regex(line, '[\t\r ]+'), lambda x: x <> '' AND x NOT IN ('<s>', '</s>', '<unk>'))"
Q = r"list_filter(string_split_regex(line, '[ \t\x0b\f\r]+'), lambda x: x <> '')"


def lines(name: str, table: str, ident: str, column: str = "text") -> str:
    """(ident, line number, line) of a text column."""
    body = f"string_split(CASE WHEN ends_with({column}, chr(10)) THEN left({column}, length({column}) - 1) ELSE {column} END, chr(10))"
    return f"{name} AS (SELECT d, ln, ls[ln + 1] AS line FROM (SELECT d, ls, unnest(range(0, len(ls))) AS ln FROM (SELECT {ident} AS d, {body} AS ls FROM {table} WHERE {column} IS NOT NULL)))"


def grams(p: str, source: str, order: int) -> str:
    """{p}raw (g, c): padded n-grams of the lines of ``source``."""
    pad = "[" + ", ".join(["'<s>'"] * (order - 1)) + "]" if order > 1 else "[]::VARCHAR[]"
    return f"{p}raw AS (SELECT array_to_string(list_slice(p, i, i + {order - 1}), ' ') AS g, count(*) AS c FROM (SELECT p, unnest(range(1, len(p) - {order - 1} + 1)) AS i FROM (SELECT list_concat(list_concat({pad}, {W}), ['</s>']) AS p FROM {source})) GROUP BY 1)"


def adjusted(p: str, order: int) -> str:
    """{p}a1 ... {p}aN (g, a, raw), from {p}raw."""
    out = []
    for n in range(1, order + 1):
        if n == order:
            if n == 1:
                out.append(f"{p}a1 AS (SELECT g, c AS a, c AS raw FROM {p}raw UNION ALL SELECT unnest(['<unk>', '<s>']), 0, 0)")
            else:
                out.append(f"{p}a{n} AS (SELECT g, c AS a, c AS raw FROM {p}raw WHERE split_part(g, ' ', 2) <> '<s>')")
            continue
        low = f"array_to_string(list_slice(string_split(g, ' '), {order - n + 1}, {order}), ' ')"
        s = f"SELECT {low} AS s, count(DISTINCT split_part(g, ' ', {order - n})) AS lefts, sum(c)::BIGINT AS raw FROM {p}raw GROUP BY 1"
        if n == 1:
            out.append(f"{p}a1 AS (SELECT s AS g, lefts AS a, raw FROM ({s}) WHERE s <> '<s>' UNION ALL SELECT unnest(['<unk>', '<s>']), 0, 0)")
        else:
            out.append(f"{p}a{n} AS (SELECT s AS g, CASE WHEN split_part(s, ' ', 1) = '<s>' THEN raw ELSE lefts END AS a, raw FROM ({s}) WHERE split_part(s, ' ', 2) <> '<s>')")
    return ",\n".join(out)


def marks(p: str, order: int, prune: list[int], vocab: str | None) -> str:
    """{p}m1 ... (g, a, raw, pruned)."""
    out = []
    for n in range(1, order + 1):
        t = prune[min(n, len(prune)) - 1]
        cond = f"(raw <= {t})" if t else "false"
        if vocab:
            cond += f" OR len(list_filter(string_split(g, ' '), lambda x: x NOT IN ('<s>', '</s>', '<unk>') AND NOT list_contains(vs, x))) > 0"
        if n == 1:
            cond = f"({cond}) AND g NOT IN ('<unk>', '<s>', '</s>')"
        src = f"{p}a{n}, (SELECT list(w) AS vs FROM {vocab})" if vocab else f"{p}a{n}"
        if vocab:  # by words, as lists of a whole vocabulary are slow to search
            bad = f"SELECT DISTINCT g FROM (SELECT g, unnest(string_split(g, ' ')) AS w FROM {p}a{n}) x WHERE w NOT IN ('<s>', '</s>', '<unk>') AND NOT EXISTS (SELECT 1 FROM {vocab} v WHERE v.w = x.w)"
            cond = (f"(raw <= {t}) OR " if t else "") + "b.g IS NOT NULL"
            if n == 1:
                cond = f"({cond}) AND q.g NOT IN ('<unk>', '<s>', '</s>')"
            out.append(f"{p}m{n} AS (SELECT q.g, a, raw, ({cond}) AS pruned FROM {p}a{n} q LEFT JOIN ({bad}) b ON q.g = b.g)")
        else:
            out.append(f"{p}m{n} AS (SELECT g, a, raw, ({cond}) AS pruned FROM {src})")
    return ",\n".join(out)


def discounts(p: str, order: int, fallback: tuple[float, float, float] = (0.5, 1.0, 1.5)) -> str:
    """{p}coc (ord, n1..n4, total, kept) and {p}d (ord, d1, d2, d3)."""
    rows = " UNION ALL ".join(f"SELECT {n} AS ord, a, pruned FROM {p}m{n}" for n in range(1, order + 1))
    k = ", ".join(f"count(*) FILTER (WHERE a = {i}) AS n{i}" for i in (1, 2, 3, 4))
    d = [f"{i} - {i + 1} * y * n{i + 1} / n{i}" for i in (1, 2, 3)]
    ok = " AND ".join(f"({x}) BETWEEN 0 AND {i}" for i, x in enumerate(d, 1))
    good = f"CASE WHEN n1 > 0 AND n2 > 0 AND n3 > 0 THEN {ok} ELSE false END"
    return f"""{p}coc AS (SELECT ord, {k}, count(*) AS total, count(*) FILTER (WHERE NOT pruned) AS kept FROM ({rows}) GROUP BY ord),
{p}d AS (SELECT ord, {", ".join(f"CASE WHEN {good} THEN {x} ELSE {fallback[i - 1]} END::DOUBLE AS d{i}" for i, x in enumerate(d, 1))} FROM (SELECT *, n1 / (n1 + 2.0::DOUBLE * n2) AS y FROM {p}coc))"""


def estimate(p: str, order: int, pad: int = 0, interpolate: bool = True, collapse: bool = False) -> str:
    """{p}g1 ... (ctx, den, gamma), {p}p1 ... (g, p, b) and {p}model (ord, g, lp, lb)."""
    out = []
    ctx = {n: "''" if n == 1 else f"array_to_string(list_slice(string_split(g, ' '), 1, {n - 1}), ' ')" for n in range(1, order + 1)}
    low = "substr(g, strpos(g, ' ') + 1)"
    dis = "(a - CASE WHEN a = 0 THEN 0 WHEN a = 1 THEN d1 WHEN a = 2 THEN d2 ELSE d3 END) / den"
    for n in range(1, order + 1):
        cs = ", ".join(f"count(*) FILTER (WHERE NOT pruned AND {c}) AS c{i}" for i, c in ((1, "a = 1"), (2, "a = 2"), (3, "a >= 3")))
        out.append(f"{p}g{n} AS (SELECT ctx, den, (d1 * c1 + d2 * c2 + d3 * c3 + lost) / den AS gamma FROM (SELECT {ctx[n]} AS ctx, sum(a)::DOUBLE AS den, sum(CASE WHEN pruned THEN a ELSE 0 END) AS lost, {cs} FROM {p}m{n} GROUP BY 1), {p}d WHERE ord = {n})")
    for n in range(1, order + 1):
        if n == 1:
            v = f"greatest({pad}, (SELECT kept FROM {p}coc WHERE ord = 1) - 1)"
            share = f"gamma / {v}" if interpolate else "0.0::DOUBLE"
            unk = share if interpolate else "gamma"
            x = f"SELECT g, CASE WHEN g = '<s>' THEN 1 WHEN g = '<unk>' THEN {unk} ELSE {dis} + {share} END::DOUBLE AS p, NULL::DOUBLE AS gamma FROM {p}m1, {p}g1, {p}d WHERE ord = 1 AND NOT pruned"
        else:
            x = f"SELECT m.g, ({dis} + c.gamma * l.p)::DOUBLE AS p, c.gamma FROM (SELECT *, {ctx[n]} AS ctx, {low} AS low FROM {p}m{n} WHERE NOT pruned) m JOIN {p}g{n} c ON m.ctx = c.ctx JOIN {p}p{n - 1} l ON m.low = l.g, {p}d WHERE ord = {n}"
        if n < order:
            x = f"SELECT x.g, p, x.gamma, CASE WHEN list_contains(['<unk>', '</s>'], string_split(x.g, ' ')[-1]) THEN 1 ELSE coalesce(y.gamma, 1) END::DOUBLE AS b FROM ({x}) x LEFT JOIN {p}g{n + 1} y ON x.g = y.ctx"
        else:
            x = f"SELECT *, 1.0::DOUBLE AS b FROM ({x})"
        out.append(f"{p}p{n} AS ({x})")
    if collapse:
        for n in range(1, order + 1):
            x = f"SELECT g, p, b AS delta FROM {p}p1" if n == 1 else f"SELECT m.g, m.p, l.delta / m.gamma * m.b AS delta FROM (SELECT *, {low} AS low FROM {p}p{n}) m JOIN {p}q{n - 1} l ON m.low = l.g"
            out.append(f"{p}q{n} AS ({x})")
        out.append(f"{p}model AS ({' UNION ALL '.join(f'SELECT {n} AS ord, g, log10(p * delta) AS lp, ' + ('0.0' if n < order else 'NULL') + f'::DOUBLE AS lb FROM {p}q{n}' for n in range(1, order + 1))})")
    else:
        out.append(f"{p}model AS ({' UNION ALL '.join(f'SELECT {n} AS ord, g, least(0, log10(p)) AS lp, ' + ('log10(b)' if n < order else 'NULL::DOUBLE') + f' AS lb FROM {p}p{n}' for n in range(1, order + 1))})")
    return ",\n".join(out)


def model(p: str, table: str, ident: str, order: int, column: str = "text", prune: list[int] | None = None, vocab: str | None = None, **options) -> str:
    """All of a model's parts, with the prefix ``p``."""
    return ",\n".join([lines(f"{p}l", table, ident, column), grams(p, f"{p}l", order), adjusted(p, order), marks(p, order, prune or [0], vocab), discounts(p, order), estimate(p, order, **options)])


def scored(p: str, m: str, source: str, order: int, bos: bool = True, eos: bool = True) -> str:
    """{p}w (d, ln, pos, word, oov, len, lp): scores of the words of the lines of ``source`` under the model ``m``."""
    words = f"list_concat({Q}, ['</s>'])" if eos else Q
    out = [
        f"{p}t AS (SELECT d, ln, i - 1 AS pos, ws[i] AS word FROM (SELECT d, ln, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT d, ln, {words} AS ws FROM {source})))",
        f"{p}u AS (SELECT t.*, v.g IS NULL AS oov, coalesce(v.g, '<unk>') AS w FROM {p}t t LEFT JOIN (SELECT g FROM {m} WHERE ord = 1 AND g <> '<unk>') v ON t.word = v.g)",
    ]
    lag = lambda k: f"CASE WHEN pos = {k - 1} THEN {'' if bos else 'NULL --'}'<s>'\n ELSE lag(w, {k}) OVER (PARTITION BY d, ln ORDER BY pos) END" if bos else f"lag(w, {k}) OVER (PARTITION BY d, ln ORDER BY pos)"
    out.append(f"{p}h AS (SELECT *, " + ", ".join(f"{lag(k)} AS h{k}" for k in range(1, order)) + f" FROM {p}u)")
    key = {k: " || ' ' || ".join([f"h{j}" for j in range(k - 1, 0, -1)] + ["w"]) for k in range(1, order + 1)}
    hist = {k: " || ' ' || ".join(f"h{j}" for j in range(k, 0, -1)) for k in range(1, order)}
    joins = " ".join(f"LEFT JOIN {m} e{k} ON e{k}.ord = {k} AND e{k}.g = {key[k]}" for k in range(1, order + 1)) + " " + " ".join(f"LEFT JOIN {m} b{k} ON b{k}.ord = {k} AND b{k}.g = {hist[k]}" for k in range(1, order))
    score = "e1.lp"
    for k in range(2, order + 1):
        score = f"coalesce(e{k}.lp, coalesce(b{k - 1}.lb, 0) + {score})"
    long = "CASE " + " ".join(f"WHEN e{k}.g IS NOT NULL THEN {k}" for k in range(order, 0, -1)) + " END"
    out.append(f"{p}w AS (SELECT d, ln, pos, word, oov, {long} AS len, {score} AS lp FROM {p}h {joins})")
    return ",\n".join(out)


def with_(*parts: str) -> str:
    """The parts, each computed once however often it is used."""
    return "WITH " + re.sub(r"(^|,\n)(\w+) AS \(", r"\1\2 AS MATERIALIZED (", ",\n".join(parts)) + "\n"
