"""Training-data operators: ten corpus components, each with its own contract query.

Nothing outside this folder imports it; the folder can be deleted.
"""
