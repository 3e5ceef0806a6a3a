import re


def words(text, lower=False):
    """Reference tokenizer of the tests."""
    text = text or ""
    if lower:
        text = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", text)
