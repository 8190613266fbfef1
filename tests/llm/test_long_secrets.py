"""Secrets longer than 128 characters are replaced whole."""

import random

from facetframe.llm import pii


def test_long_secrets(spark):
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    run = lambda n, more="": "".join(r.choice(letters + more) for _ in range(n))
    start = run(128, "0123456789")
    jwt = f"{start}.{run(300, '0123456789')}.{run(170, '-_')}"
    secrets = [jwt, start + run(472, "0123456789"), run(300) + "7" + run(299), "7" * 600]
    rows = [(i, f"before token={s} behind {s[-40:]}") for i, s in enumerate(secrets)] + [(9, f"token={jwt}, again"), (10, "token=" + run(600))]
    out = {row["doc_id"]: row for row in pii.replaced(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    new = {}
    for i, s in enumerate(secrets):
        words = out[i]["text"].split(" ")
        new[i] = words[1].removeprefix("token=")
        assert words[0] == "before" and words[2] == "behind" and out[i]["n_replaced"] == 1
        assert len(new[i]) == len(s)
        assert not any(s[k : k + 12] in new[i] for k in range(len(s) - 11))
    assert len(set(new.values())) == len(secrets)
    assert out[9]["text"] == f"token={new[0]}, again"
    assert new[3][:64] != new[3][64:128]
    assert out[10]["n_replaced"] == 0 and out[10]["text"] == rows[-1][1]
