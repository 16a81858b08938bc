"""Plans: which object goes to which pack, what a restore does, what is published."""
