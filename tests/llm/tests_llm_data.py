import random


def labelled_rows(n, seed=5):
    """Documents of which some hold a word of abuse and some are junk, with their labels."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(15, 80))]
        toxic, junk = rng.random() < 0.25, rng.random() < 0.25
        if junk:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), "venom" + rng.choice(["", "ous", "ed", "ish", "ly"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), int(not junk)))
    return rows, labels
