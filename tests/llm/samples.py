"""Texts for the tests of the corpus operators."""

WORDS = ("alder birch cedar drift ember flint grove heath inlet jetty knoll ledge marsh north oxbow plain quarry "
         "ridge shoal thorn upland vale wharf yonder zephyr").split()

#: Texts that every operator has to take.
ODD = [(1, None), (2, ""), (3, "one"), (4, "one"), (4, "one"), (5, " \n\t\n "), (None, "no id here at all"),
       (6, "x " * 60_000), (7, "Ünï cödé ß 漢字 текст\n\nline"), (None, None), (8, "a\x0bb\x0cc\rd\x1ce")]
