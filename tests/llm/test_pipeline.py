"""The pipeline against a plain composition of its stages' meaning."""

import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import base_spans
from tracewell.llm import perplexity, simhash
from tracewell.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "personal data", "tokens"]


def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    # Enough other texts that a text's own copy hardly moves the model which scores it.
    texts = [prose(rng.randint(80, 160)) for _ in range(30)]
    others = [prose(rng.randint(80, 160)) for _ in range(400)]
    item = prose(14)
    texts += [texts[3], texts[4], texts[5] + " " + item, texts[6] + " write to ab.c@mail.example.com now", "short text", prose(3) * 40, None, ""]
    texts += others
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = {r.doc_id for r in perplexity.quality_rules(docs).where("kept").collect()}
    assert not kept & {34, 35, 36, 37} and len(kept) >= 420
    classes = simhash.near_duplicates(docs.where(docs.doc_id.isin(sorted(kept)))).collect()
    heads = {r.component_id for r in classes}
    assert 30 not in heads and 31 not in heads
    left = {k for k in heads if item not in (texts[k] or "")}
    library = Tokenizer.from_file(tokenizer_path())
    want = {}
    for k in left:
        text, at, out = texts[k], 0, []
        for a, kind, b in base_spans(text):
            out += [text[at:a], f"<{['EMAIL', 'IP', 'CARD', 'PHONE'][kind]}>"]
            at = b
        ids = library.encode("".join(out) + text[at:], add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())
    assert got == want
