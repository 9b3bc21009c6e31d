"""The pipeline against plain Python, stage by stage, on a small table with planted cases."""

import hashlib
import shutil
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from barwright.llm import decontam
from barwright.llm.common import Staged, table
from test_operators import WORD, plain_components, plain_shingles, plain_targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    """sf0.001 with near copies, other scripts, letterless texts and benchmark passages added."""
    folder = tmp_path_factory.mktemp("planted")
    shutil.copy(f"{SF}/benchmark.parquet", folder)
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    long = docs[docs["text"].str.len() > 2000]["text"].tolist()
    made = ["Это русский текст о погоде и природе, длинный и ясный", "これは日本語の文章です。今日は良い天気", "12 34 !!", "", None]
    for t in long[:6]:
        words = t.split(" ")
        for at in ([len(words) // 2], [3, len(words) // 3], list(range(0, len(words), 9))):  # near, near, far
            changed = list(words)
            for i in at:
                changed[i] = "Changedword"
            made.append(" ".join(changed))
    made += [long[7] + " " + bench["text"][0] + " " + long[8], "It is said that " + bench["text"][1]]
    first = int(docs["doc_id"].max()) + 1
    more = pd.DataFrame({"doc_id": range(first, first + len(made)), "text": made, "lang": None, "source": "src0", "n_chars": [len(m or "") for m in made]})
    more.loc[more.index[-3:], "source"] = ["new", None, None]
    pd.concat([docs, more], ignore_index=True).astype({"doc_id": "int64", "n_chars": docs["n_chars"].dtype}).to_parquet(folder / "documents.parquet")
    return str(folder)


def test_the_pipeline_against_brute_force(spark, planted):
    docs = table(spark, planted, "documents")
    columns, held = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = Staged(stage(spark, docs, planted), f"test-{name}").read()
        held.append(docs.toPandas())
        assert name == "tokens" or docs.columns == columns
    language, near, clean, mixed, tokens = held
    rows = pd.read_parquet(f"{planted}/documents.parquet")
    texts = dict(zip(rows["doc_id"], rows["text"]))
    first = len(pd.read_parquet(f"{SF}/documents.parquet"))

    # language: prose of the languages learned stays, the five planted texts that are none go
    gone = set(rows["doc_id"]) - set(language["doc_id"])
    assert gone == set(rows["doc_id"][first : first + 5])

    # near copies: all pairs of five-word shingle sets
    sets = {i: plain_shingles(texts[i]) for i in language["doc_id"]}
    ids = sorted(sets)
    linked = [(i, j) for k, i in enumerate(ids) for j in ids[k + 1 :] if sets[i] & sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    group = plain_components(ids, linked)
    assert any(sets[i] != sets[j] for i, j in linked)
    assert sorted(near["doc_id"]) == sorted(set(group.values()))

    # benchmark: documents with 0.8 of an item's windows of five words
    def windows(text):
        w = [x for x in (x.strip(decontam.EDGES).lower() for x in WORD.findall(text or "")) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    items = [windows(t) for t in pd.read_parquet(f"{planted}/benchmark.parquet")["text"]]
    leaks = {i for i in near["doc_id"] if any(len(x & windows(texts[i])) >= 0.8 * len(x) > 0 for x in items)}
    assert {int(rows["doc_id"].iloc[-1]), int(rows["doc_id"].iloc[-2])} <= leaks
    assert sorted(clean["doc_id"]) == sorted(set(near["doc_id"]) - leaks)

    # mixing: packets of all documents in one list by finish time, cut at the budget
    size = {i: len(WORD.findall(texts[i] or "")) for i in clean["doc_id"]}
    queues = {s: sorted(part["doc_id"], key=lambda i: hashlib.md5(f"mix|{i}".encode()).hexdigest()) for s, part in clean.groupby(clean["source"].fillna("\U0010ffff"))}
    sizes = {s: sum(size[i] for i in q) for s, q in queues.items()}
    target = plain_targets(sizes, {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(sizes))}, 1.5 * sum(sizes.values()))
    packets, taken = [], dict.fromkeys(size, 0)
    for s, q in queues.items():
        at = 0
        for i in q * 2:
            inside = min(max(int(target[s]) - at, 0), size[i])
            packets += [((at + w) / target[s], i, n) for n, w in ((inside, inside), (size[i] - inside, size[i])) if n]
            at += size[i]
    left = sum(map(int, target.values()))
    for _, i, n in sorted(packets):
        n = min(n, left)
        taken[i], left = taken[i] + n, left - n
    times = {i: int(np.floor(taken[i] / max(size[i], 1) + 0.5)) for i in taken}
    assert mixed["doc_id"].value_counts().to_dict() == {i: n for i, n in times.items() if n}

    # tokens: in order of doc_id, by the plain tokenizer
    plain, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i in sorted(mixed["doc_id"]):
        ids = np.array(plain.encode(texts[i] or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tokens.itertuples(index=False, name=None)) == want

    # and all stages in one
    assert sorted(corpus_pipeline.run(spark, planted).toPandas().itertuples(index=False, name=None)) == want
