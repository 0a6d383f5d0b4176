"""Training-data operators: ten corpus jobs over documents, conversations, labels and benchmark tables.

Nothing else in the library imports this subpackage.
"""
