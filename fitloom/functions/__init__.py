"""Column-level building blocks: text, markup, scoring terms and lexicons."""
