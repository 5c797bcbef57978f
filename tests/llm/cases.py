"""Where the smallest tables are, and odd texts."""

SF = "/root/testdata/sf0.001"

#: Texts with odd white space, special strings, combining marks and letters whose case folds oddly.
ODD_TEXTS = [
    None, "", " ", "\n\n", "word", "Two  words ", "áb ́c", "x　y   z", "tab\tand\x0bvt\x0cff\r\nend", "a\x1cb \x1c c\x1d",
    "<|endoftext|>in text<|startoftext|>", "It's they'll 'sand 're", "İSTANBUL ΣΑΣ ß", "12345 6,7.8", "  lead", "trail  ", " em   space",
    "emoji 🙂🙂 mix", "A" * 3000, "b c " * 5000, "Ⅷ ² ½ _x_", "̀start", "ȩ́ order", "\u0085next line",
]
