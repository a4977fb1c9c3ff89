"""Words that are not telling by themselves still find the examples they stand in."""

from __future__ import annotations

import random
import zlib

import numpy as np

from shelflink.llm.toxicity import document_counts, fit_toxicity, scored


def test_copy_of_a_toxic_example_without_telling_words(docs_of, labels_of):
    rng = random.Random(5)
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 == 1]
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 != 1][:200]
    common = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in train:
        docs.append((i, " ".join(rng.choice(common) for _ in range(40)) + f" only{i} also{i}"))
        labels.append((i, 1, int(i == train[7] or i == train[11] or rng.random() < 0.1)))
    toxic = dict(docs)[train[7]]
    docs += [(held[0], toxic), (held[1], "nothing known"), (held[2], toxic.upper() + "!")]
    found = {r.doc_id: r for r in scored(docs_of(docs), labels_of(labels)).collect()}
    assert found[held[0]].neighbours[0] == found[held[2]].neighbours[0] == train[7]
    assert len(found[held[0]].neighbours) == 15 and found[held[0]].terms == []
    assert found[held[1]].neighbours == []
    # Every word of the examples is indexed, with document counts over all documents.
    model = fit_toxicity(docs_of(docs), labels_of(labels))
    assert len(model.index.number) == len({w for i, t in docs if i in set(train) for w in t.split()})
    n, counts = document_counts(docs_of([*docs, (None, None), (1, f"only{train[7]}")]), model.index.number)
    assert n == len(docs) + 2 and counts[model.index.number[f"only{train[7]}".encode()]] == 4
    at, cos = model.index.nearest(model.index.vector(toxic.encode().split()))
    assert model.index.ids[at[0]] == train[7] and np.isclose(cos[0], 1)
