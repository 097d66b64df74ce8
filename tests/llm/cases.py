"""Rows that tests share."""

SF = "/root/testdata/sf0.001"

#: Nulls, empty and odd texts, repeated rows and ids.
ODD_TEXTS = [(1, "Hello world\nagain"), (2, None), (3, ""), (4, "  two  blanks \n\n tabs\tand\r\nmore "), (5, "été naïve wide 'quoted' don't"), (6, "x" * 5000), (7, "a b " * 3000), (None, "no id"), (1, "Hello world\nagain"), (9, "\n"), (10, "日本語 text 🎉 123 <|endoftext|>")]
