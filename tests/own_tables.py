"""Small tables of documents and conversations in words of our own."""

import random

WORDS = "amber basil cedar dune ember fjord grove heron islet juniper kelp lagoon maple nettle ochre pebble".split()


def documents(spark, n=4000):
    """(doc_id, text): a random number of random words."""
    rnd = random.Random(n)
    rows = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(30, 170)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


def conversations(spark, n=4000):
    """(conv_id, turn, role, text): one to four questions, each with an answer."""
    rnd = random.Random(-n)
    rows = []
    for i in range(n):
        for turn in range(rnd.randint(1, 4)):
            rows.append((i, 2 * turn, "user", "Where does " + rnd.choice(WORDS) + " grow?"))
            rows.append((i, 2 * turn + 1, "assistant", "Near " + " and ".join(rnd.choices(WORDS, k=rnd.randint(2, 8))) + "."))
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
