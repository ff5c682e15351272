"""Queries over whole tables against plain Python: texts beyond ASCII have no SQL."""

import hashlib
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from oracle import SMALL, plain
from test_text import distance, plain_normal

from quireflow.plans import corpus, registry  # noqa: F401  corpus fills the registry

TOKEN = re.compile(r"[؀-ۿ]+|[A-Za-z]+|\d+(?:[./:-]\d+)*|\S")
squeeze = lambda t: re.sub(r"\s+", " ", t or "").strip()
mean = lambda v: sum(v) / len(v)


@pytest.fixture(scope="module")
def turns():
    return pq.read_table(f"{SMALL}/conversations.parquet").to_pylist()


@pytest.fixture(scope="module")
def pairs(turns):
    by, out = defaultdict(list), []
    for r in turns:
        by[r["conv_id"]].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: (r["turn"], r["role"], r["text"]))
        for r, n in zip(rows, rows[1:]):
            t, p = squeeze(r["text"]), squeeze(n["text"])
            x = {"conv_id": r["conv_id"], "turn": r["turn"], "field": r["role"], "truth": t, "predicted": p}
            nt, np_ = plain_normal(t), plain_normal(p)
            lt, lp = squeeze(nt.lower()), squeeze(np_.lower())
            x |= {"d": distance(np_, nt), "n": len(nt), "raw": distance(p, t), "exact": float(lt == lp), "tt": TOKEN.findall(nt), "tp": TOKEN.findall(np_)}
            x["edit"] = max(0.0, 1 - distance(lp, lt) / len(lt)) if lt else float(not lp)
            x["cer"] = x["d"] / x["n"] if x["n"] else float(bool(np_))
            out.append(x)
    return out


def got(spark, name):
    df = registry.QUERIES[name](spark, SMALL)
    return Counter(tuple(plain(v) for v in r) for r in df.collect())


def rounded(rows):
    return Counter(tuple(plain(round(v, 9) if isinstance(v, float) else v) for v in r) for r in rows)


def test_tables_hold_more_than_ascii(turns, pairs):
    assert any(not r["text"].isascii() for r in turns) and any(not p["truth"].isascii() for p in pairs)


def test_texts(spark, turns):
    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    sha = lambda t: hashlib.sha256(squeeze(plain_normal(t).lower()).encode()).hexdigest()
    assert got(spark, "text_normalize") == Counter((r["doc_id"], sha(r["text"])) for r in docs)
    tokens = [(r, TOKEN.findall(plain_normal(r["text"]))) for r in turns]
    assert got(spark, "tokenize") == Counter((r["conv_id"], r["turn"], len(t), " ".join(t)) for r, t in tokens)


def test_rates(spark, pairs):
    assert got(spark, "cer_pairs") == rounded((p["conv_id"], p["turn"], p["d"], p["cer"]) for p in pairs)
    wer = [(p, distance(p["tp"], p["tt"]), len(p["tt"])) for p in pairs]
    assert got(spark, "wer_pairs") == rounded((p["conv_id"], p["turn"], d, n, d / n if n else float(bool(p["tp"]))) for p, d, n in wer)
    full = [p for p in pairs if p["truth"]]
    worst = sorted(((p["conv_id"], p["turn"], round(p["cer"], 9)) for p in full), key=lambda r: (-r[2], r[0], r[1]))[:20]
    assert got(spark, "worst20") == rounded(worst)
    bins = Counter(min(int(max(0, min(3, p["cer"])) / 3 * 30) + 1, 30) for p in full)
    assert got(spark, "cer_histogram") == Counter(bins.items())
    by = defaultdict(list)
    for p in pairs:
        by[p["conv_id"]].append(p)
    joined = {c: [plain_normal(" ".join(p[k] for p in sorted(v, key=lambda p: (p["turn"], p["predicted"], p["truth"])))) for k in ("predicted", "truth")] for c, v in by.items()}
    assert got(spark, "concatenated_cer") == rounded((c, distance(p, t) / len(t) if t else float(bool(p))) for c, (p, t) in joined.items())


def test_scores(spark, pairs):
    by = defaultdict(list)
    for p in pairs:
        by[p["field"]].append(p)
    fields = {f: (mean([p["exact"] for p in v]), mean([p["edit"] for p in v]), len(v)) for f, v in by.items()}
    assert got(spark, "field_accuracy") == rounded((f, *v) for f, v in fields.items())
    assert got(spark, "macro_micro_fields") == rounded([(mean([v[0] for v in fields.values()]), mean([v[1] for v in fields.values()]), mean([p["exact"] for p in pairs]), mean([p["edit"] for p in pairs]))])
    assert got(spark, "global_cer_micro") == rounded((f, sum(p["d"] for p in v) / max(1, sum(p["n"] for p in v)), len(v)) for f, v in by.items())
    assert got(spark, "failures") == Counter((p["conv_id"], p["turn"], p["field"], p["predicted"], p["truth"]) for p in pairs if not p["exact"])
    seen = [p for p in pairs if p["turn"] % 4]
    d, n, w = sum(p["raw"] for p in seen), sum(len(p["truth"]) for p in seen), sum(len(p["truth"].split()) for p in seen)
    each = [p["raw"] / max(1, len(p["truth"])) if p["turn"] % 4 else 1.0 for p in pairs]
    assert got(spark, "ocr_evaluation") == rounded([(d / max(1, n), d / max(1, w), mean(each), len(pairs), len(seen))])


def test_confusions(spark, pairs):
    n = Counter((t, p) for x in pairs for t, p in zip(x["truth"], x["predicted"]) if t != p)
    rows = [(*k, v) for k, v in n.items()]
    assert got(spark, "char_confusions") == Counter(rows) and any(not t.isascii() for t, _ in n)
    assert got(spark, "char_confusions_top20") == Counter(sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[:20])
    chars = {t for t, p in n if p in "et "}
    assert got(spark, "confusion_chars_pivot") == Counter((t, *[float(n[t, p]) for p in "et "]) for t in chars)
