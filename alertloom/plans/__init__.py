"""The registered queries: driver tables bound to the operational tables, and their oracles."""
