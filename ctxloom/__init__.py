"""ctxloom: context-document assembly as Spark jobs.

Catalogues of files, pages and documents (many projects at once) are pruned by
ignore rules, rolled up over folder trees, cleaned, capped and assembled into
one ordered context document per project, all as DataFrame plans.
"""

__version__ = "0.1.0"
