import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from snapcat.llm import jaccard, langid, mixing, packing, secrets
from snapcat.llm import text as tx

from .conftest import words
from .test_jaccard import brute as plain_groups
from .test_langid import brute_predict
from .test_langid import corpus as languages
from .test_mixing import fill, plain_documents
from .test_secrets import brute as base_spans


def rows():
    rng = np.random.default_rng(0)
    out = [(i, t + " " + words(rng, 30, 10**6).replace("w", "th"), lang, s) for i, t, lang, s in languages(150)]
    out += [(500 + k, t, lang, s) for k, (_, t, lang, s) in enumerate(out[:20])]
    out += [(600 + k, f"{t} token = {'ab12' * 10}", lang, s) for k, (_, t, lang, s) in enumerate(out[30:40])]
    return [*out, (900, None, None, None), (901, "", "en", None), (902, "12 34", "en", "src1")]


def test_stages(spark, docs, tmp_path):
    docs(rows()).write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {"documents": {r.doc_id: r.text for r in df.collect()}}
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert df.columns == columns
            seen[name] = {r.doc_id: r.text for r in df.collect()}
    assert set(seen["documents"]) - set(seen["language_id"]) >= {900, 901, 902}
    assert len(seen["language_id"]) >= 175
    assert not set(seen["near_duplicates"]) & set(range(500, 520)) and len(seen["near_duplicates"]) > 140
    assert not any("ab12ab12" in t for t in seen["secret_scan"].values())
    assert set(seen["secret_scan"]) == set(seen["near_duplicates"])
    mixed = spark.read.parquet(str(tmp_path / "mix_sources"))
    assert df.agg(F.sum("n_tokens")).first()[0] == mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))


def plain_redact(text, model):
    """Every span of a pattern or of the field replaced; the field decoded by a plain Viterbi over the whole text."""
    data, offsets = tx.string_buffers(pa.array([text]))
    starts, ends, _, x = secrets.features(data, offsets)
    spans = [(a, b) for _, a, b in base_spans(text)]
    if len(starts):
        e, t = model.emissions(x), model.transitions
        score, back = t[0] + e[0], []
        for k in range(1, len(e)):
            step = score[:, None] + t
            back.append(step.argmax(0))
            score = step.max(0) + e[k]
        states = [int((score + t[:, 0]).argmax())]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        states.reverse()
        raw, runs = text.encode(), []
        for k, state in enumerate(states):
            if state == 1 or (state == 2 and not (k and states[k - 1])):
                runs.append([k, k])
            elif state == 2:
                runs[-1][1] = k
        base = list(spans)

        def span(a, b):
            lo, hi = int(starts[a]), int(ends[b])
            while lo < hi and chr(raw[lo]) in "\"'`,;:=()[]{}<>":
                lo += 1
            while hi > lo and chr(raw[hi - 1]) in "\"'`,;:=()[]{}<>":
                hi -= 1
            return len(raw[:lo].decode()), len(raw[:hi].decode())

        free = lambda s: all(s[1] <= x or y <= s[0] for x, y in base)
        for a, b in runs:
            # of a run that meets a pattern's match the other words stay
            parts = [[a, b]] if free(span(a, b)) else []
            for k in [] if parts else [k for k in range(a, b + 1) if free(span(k, k))]:
                if parts and parts[-1][1] == k - 1:
                    parts[-1][1] = k
                else:
                    parts.append([k, k])
            spans += [x for x in (span(*p) for p in parts) if x[0] < x[1]]
    out, end = [], 0
    for a, b in sorted(spans):
        out += [text[end:a], "[SECRET]"] if a >= end else []
        end = max(end, b)
    return "".join([*out, text[end:]])


def plain_copies(rows):
    """Copies of each row (id, text, lang, source): systematic sampling along (size, slice, id) of a source."""
    size, by = {}, {}
    digest = lambda x, n: int(hashlib.md5(x.encode()).hexdigest()[:n], 16)
    for i, t, _, s in rows:
        n = len(t.split())
        size[s] = size.get(s, 0) + n
        by.setdefault(s, []).append((n, digest(str(i), 2) % mixing.SLICES, i))
    target, copies = fill(size), {}
    for s, own in by.items():
        rate, u = target[s] / size[s] if size[s] else 0.0, digest("42:" + ("null" if s is None else "s" + s), 8) / 2**32
        for k, (_, _, i) in enumerate(sorted(own), 1):
            copies[i] = min(3, math.floor(k * rate + u) - math.floor((k - 1) * rate + u))
    return copies


def test_run_matches_brute_force(spark, docs, tmp_path):
    """Five plain stages, given the models that the stages learn."""
    rng = np.random.default_rng(6)
    table = [r for r in rows() if not (500 <= r[0] < 515)]
    table += [(700 + k, f"{t[::-1]} {words(rng, 30, 10**6).replace('w', 'th')} {x} {t}", lang, s) for k, ((_, t, lang, s), x) in enumerate(zip(languages(12), [f"token = {'ab12' * 10}", "credential: Zx81kLmQ09aPv7cDtY55hhGf", f"Ünï {'0f' * 20} password='abcd1234'"] * 4, strict=True))]
    docs(table).write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = langid.train_langid(df)
    table = [r for r in table if (p := brute_predict(model, r[1] or ""))[0] != "und" and p[1] >= 0.3]
    assert 160 < len(table)
    groups = {d: (n, c) for d, n, c in plain_groups([r[:2] for r in table])}
    table = [r for r in table if not groups[r[0]][0] or groups[r[0]][1] == r[0]]
    field = secrets.train_crf(docs(table))
    table = [(i, plain_redact(t, field), lang, s) for i, t, lang, s in table]
    assert sum("[SECRET]" in t for _, t, *_ in table) >= 10
    copies = plain_copies(table)
    assert {0, 1, 2} <= set(copies.values()) or len(set(copies.values())) > 1
    taken = [(i, len(t.split())) for i, t, *_ in table for _ in range(copies[i])]
    expected = plain_documents([x for x in taken if x[1]], packing.CAPACITIES, packing.BIN_COST, packing.SHARD_PIECES)
    out = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "n_tokens", "shard", "bin", "capacity", "used")
    assert sorted(map(tuple, out.collect())) == sorted(expected)


def test_empty_table(spark, docs, tmp_path):
    docs(["x"]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scan", "mix_sources", "best_fit_packing"]
    assert all((jaccard.one_per_group, secrets.redact_secrets, langid.keep_languages))
