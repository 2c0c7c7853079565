"""News-corpus curation and annotation agreement as Spark DataFrame operators.

* ``functions``: Column -> Column expressions (text, URLs, labels, votes, scores)
* ``operators``: DataFrame -> DataFrame steps, all lazy
* ``sources``: readers and writers for the file formats of the corpus
* ``plans``: the four stages, each wired from the operators above
* ``streaming``: the curation stage as a restartable append
"""
