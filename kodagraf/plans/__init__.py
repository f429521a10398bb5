"""The registered queries, their SQL counterparts, and the request front."""
