"""Repository-graph analytics and text processing as DataFrame operators."""
