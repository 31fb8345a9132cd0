"""Social-listening analytics as lazy DataFrame operators."""
