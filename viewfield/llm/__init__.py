"""Training-data operators: encoding, search for copies, classifiers and stored forms.

Nothing outside this package imports it.  ``queries`` holds the registered queries.
"""
