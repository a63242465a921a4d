"""Matrix and graph operators."""
