"""Training-data operators: filters, joins, sketches, packing and token counts over documents and pages.

Nothing else in the library imports this subpackage.
"""
