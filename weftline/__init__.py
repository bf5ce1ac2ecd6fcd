"""weftline: declarative analytics over block-aligned, multilingual text corpora on PySpark."""
