"""python -m pathweave.llm.train_pii DOCUMENTS MEMBERS OUT.npz [STEPS]: trains the tagger of ``pii`` and writes its weights.

DOCUMENTS and MEMBERS are Parquet files (doc_id, text) and (given_name, family_name). The labelled sample is the first
``pii.SAMPLE_ROWS`` documents by a hash of the id; a tenth of it is held out to report agreement with the labels.
"""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import xxhash

from . import pii


def main(documents: str, members: str, out: str, steps: str | None = None) -> None:
    docs = pq.read_table(documents, columns=["doc_id", "text"]).to_pylist()
    docs = sorted((d for d in docs if d["text"]), key=lambda d: xxhash.xxh64_intdigest(str(d["doc_id"])))[: pii.SAMPLE_ROWS]
    roster = [(m["given_name"], m["family_name"]) for m in pq.read_table(members).to_pylist()]
    held = [d["text"] for d in docs[: len(docs) // 10]]

    def log(losses: list[float]) -> None:
        for k in range(0, len(losses), 100):
            print(f"step {k}: loss a character {sum(losses[k : k + 100]) / len(losses[k : k + 100]):.5f}", flush=True)

    tagger = pii.fit([d["text"] for d in docs[len(docs) // 10 :]], roster, int(steps or pii.STEPS), log=log)
    Path(out).write_bytes(tagger.dump())
    given, family = frozenset(g for g, _ in roster if g), frozenset(f.lower() for _, f in roster if f)
    n: Counter = Counter()
    for text, spans in zip(held, pii.detect(pii.Tagger.load(tagger.dump()), held, given)):
        want, got = set(pii.label_spans(text, given, family)), set(spans)
        for name, group in (("both", want & got), ("only labelled", want - got), ("only found", got - want)):
            n.update((k, name) for _, _, k in group)
    for k in pii.KINDS:
        print(k, {name: n[k, name] for name in ("both", "only labelled", "only found")})


if __name__ == "__main__":
    main(*sys.argv[1:])
