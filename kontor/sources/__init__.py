"""File sources: bank exports and secondary activity exports."""
