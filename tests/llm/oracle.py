"""Plain versions that operators are held against."""


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def shingles(text, shingle=5):
    words = lower(text or "").encode().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def firsts(texts):
    """Of each component of the pairs with a similarity of 0.8 or more, the smallest id."""
    root, sets = {i: i for i in texts}, {i: shingles(t) for i, t in texts.items()}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return sorted(i for i in texts if root[i] == i)
