"""The retail model and its analyses."""
