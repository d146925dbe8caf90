"""Steps of a corpus build as DataFrame transformations."""
