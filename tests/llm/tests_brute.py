"""The pipeline in plain Python, over small tables."""

import hashlib
import re

import numpy as np
import pyarrow.parquet as pq

from lexmill.llm import bpe, queries
from test_dedup import brute_components, shingles, words_of
from test_rules_secrets_bpe import brute_rules


def words_raw(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def fails(t):
    n, chars, symbols, dup, repeat = brute_rules(t)
    lines = sum(1 for x in t.split("\n") if words_of(x))
    capitals, letters = len(re.findall("[A-ZÀ-ÖØ-Þ]", t)), len(re.findall("[A-Za-zÀ-ÖØ-öø-ÿ]", t))
    return n < 20 or 10 * repeat > 3 * n or 10 * symbols > 3 * n or (lines >= 4 and 2 * dup > lines) or 10 * sum(a == b for a, b in zip(words_raw(t), words_raw(t)[1:])) > 3 * n or 10 * capitals > 6 * letters or 10 * t.count("!") > 3 * n or chars > 15 * n or chars < 2 * n


def secret_spans(docs):
    out, bare = {}, {}
    for d, (t, owner) in docs.items():
        s = [(m.start(), m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[1]) >= 12]
        s += [(m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
        s += [(m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 16]
        for m in re.finditer("[A-Za-z0-9+/_=-]+", t):
            v = m[0]
            p = [v.count(c) / len(v) for c in set(v)]
            if len(v) >= 20 and re.search("[0-9]", v) and re.search("[A-Za-z]", v) and -sum(x * np.log2(x) for x in p) >= 3 and not any(a < m.end() and m.start() < b for a, b in s):
                bare.setdefault(v, []).append((d, owner, m.start(), m.end()))
        out[d] = s
    for v, at in bare.items():
        if len({o for _, o, _, _ in at}) <= 2:
            for d, _, a, b in at:
                out[d].append((a, b))
    return out


def pipeline_rows(sf_dir):
    rows = {r["doc_id"]: r for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    docs = {d: r["text"] for d, r in rows.items() if not fails(r["text"])}
    sets = {d: shingles(t) for d, t in docs.items()}
    docs = {d: docs[d] for d, c in brute_components(sets, 80).items() if c == d}
    items = [s for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist() if (s := shingles(r["text"]))]
    docs = {d: t for d, t in docs.items() if not any(100 * len(s & sets[d]) >= 80 * len(s) for s in items)}
    spans = secret_spans({d: (t, rows[d]["source"]) for d, t in docs.items()})
    own, out = bpe.WordBpe(bpe.read_spec(queries.tokenizer_path())), {}
    for d, t in docs.items():
        parts, at = [], 0
        for a, b in sorted(spans[d]):
            if a >= at:
                parts += [t[at:a], "[SECRET]"]
            at = max(at, b)
        ids = own.encode("".join(parts) + t[at:])
        out[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest())
    return out
