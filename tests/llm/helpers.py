import random


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    syllables = ["er", "in", "th", "on", "ti", "an", "re", "he", "at", "ou", "st", "nd"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words))
