"""Training-data operators over documents, pages and conversations.

Each module holds one operator with its own interface; `queries` applies them to the
tables with production parameters and `oracles` states results in SQL where it can.
"""
